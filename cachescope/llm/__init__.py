"""Training-data operators: one module per operator, plus the query registry.

Nothing else in the library imports this subpackage.
"""
