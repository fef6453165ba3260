"""Composed jobs: feature matrices, training drivers and the registered queries."""
