"""DataFrame operators, one module per stage of the graph's life."""
