"""Column functions: spans of a pattern, checksums, context."""
