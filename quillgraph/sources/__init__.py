"""Where rows come from: trees, documents, registries, code, diffs, graphs, cases."""
