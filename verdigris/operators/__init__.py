"""DataFrame -> DataFrame operators grouped by domain."""
