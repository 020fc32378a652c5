"""Operators for large training-data pipelines.

Nothing else in the package imports this subpackage; ``queries.py`` lists the
registered queries and their SQL.
"""
