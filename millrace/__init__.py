"""Declarative, incrementally maintained table graphs on Spark."""
