"""Sources of the table-graph engine."""
