"""Incremental ingest of finished run artifacts."""
