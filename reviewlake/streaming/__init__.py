"""Streaming forms of the deduplication and the ledger."""
