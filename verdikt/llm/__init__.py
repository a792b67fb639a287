"""Training-data operators: one module for each operator, and ``registry`` for their queries and SQL.

Nothing else in the library imports this subpackage.
"""
