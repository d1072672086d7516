"""Incremental ingest of files as they arrive."""
