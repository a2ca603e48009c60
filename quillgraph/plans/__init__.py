"""Whole jobs: snapshots of a graph, and the engine that builds, refreshes and asks it."""
