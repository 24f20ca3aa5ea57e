"""Column functions: parse-time scalars, scoring, excerpts and redaction."""
