"""Incremental ingest. An extension: batch tables are what the engine is made for."""
