"""Operators of the table-graph engine."""
