"""Structured Streaming versions of the ingest, alert and roll-up operators."""
