"""Readers, writers and the feature store."""
