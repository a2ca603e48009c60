"""Relational operators over the graph, the indexes and the evaluation tables."""
