"""Operators for preparing language-model training data (text, secrets, duplicates, tokens).

Nothing else in the library imports this package. Each module is one operator with its own
general interface; ``queries`` applies them to the tables and derives the result columns.
"""
