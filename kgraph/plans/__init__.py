"""Compositions of operators: runs, table mapping and the registered queries."""
