"""Training-data operators: one module an operator, queries in ``queries``.

Nothing else in the library imports this subpackage.
"""
