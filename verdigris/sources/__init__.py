"""Sources: file loaders, landed sensor payloads, staging."""
