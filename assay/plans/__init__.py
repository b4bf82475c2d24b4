"""Compositions of operators and the registered queries with their SQL oracles."""
