"""An extension: incremental reading of transcript lines."""
