"""Readers and the versioned store."""
