"""Relational operators over turns and sessions."""
