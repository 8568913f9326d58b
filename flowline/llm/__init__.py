"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; :mod:`flowline.llm.queries` registers one query per operator.
"""
