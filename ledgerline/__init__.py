"""Ledgerline: PySpark operators for validating, reconciling and summarising operational data.

Everything is a plain function from DataFrames (or Columns) to DataFrames (or
Columns).  Checks return the offending rows; ``assert_empty`` turns them into an
error where a caller wants to stop.  The ids in docstrings (W1, J6, ...) are the
"""
