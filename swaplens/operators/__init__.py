"""Table-to-table operators of the engine."""
