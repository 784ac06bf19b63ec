"""Streaming of the table-graph engine."""
