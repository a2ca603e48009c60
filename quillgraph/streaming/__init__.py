"""Keeping a graph fresh: incremental refresh, the watch loop and the reader's budget."""
