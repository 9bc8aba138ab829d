"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage. Every operator takes and
returns DataFrames; the thin queries over the test tables are in ``queries``.
"""
