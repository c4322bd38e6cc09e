"""Operators for preparing language-model training data.

Nothing else in the library imports this package. Each operator is a module with a
general interface; ``catalog`` applies every one to its whole table as a query.
"""
