"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; ``queries`` holds the thin queries that bind them to the tables.
"""
