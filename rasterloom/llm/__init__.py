"""Operators for preparing language-model training data.

Nothing outside this folder imports it.  Each operator is a function from
DataFrames to a DataFrame; ``queries`` holds the thin queries over the
``documents`` and ``conversations`` tables.
"""
