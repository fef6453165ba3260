"""Structured Streaming forms of the bar builder and the ledger."""
