"""Plans of the table-graph engine."""
