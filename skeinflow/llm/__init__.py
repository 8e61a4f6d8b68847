"""Operators for preparing language-model training corpora.

Nothing outside this folder imports it.  Every operator takes and returns
DataFrames, ignores columns it does not name, and states in its docstring what
nulls, empty texts, ties and repeated rows give.
"""
