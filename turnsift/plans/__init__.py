"""Whole queries: what happens from files to tables, and from a query to shown rows."""
