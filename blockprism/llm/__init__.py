"""Operators of a training-data pipeline over a table of documents.

Nothing else in the package imports this subpackage.  Every operator takes
DataFrames and returns DataFrames; the thin ``opN_*`` queries that apply them to
the driver's tables are in :mod:`blockprism.llm.queries`.
"""
