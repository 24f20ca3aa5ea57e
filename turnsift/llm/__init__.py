"""Training-data operators: dedup, sharding, formatting, packing, filtering, PII.

Nothing outside this folder imports it; ``queries.py`` holds the registered
queries and their SQL.
"""
