"""Functions of the table-graph engine."""
