"""Relational operators: joins, aggregations, windows, reshaping, validation, graph, vectors, batching."""
