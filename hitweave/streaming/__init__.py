"""Incremental collections: keyed versions, deletes and expiry, and ingestion through Structured Streaming."""
