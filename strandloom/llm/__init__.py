"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and returns DataFrames; what a job has to keep between steps is written as
Parquet below ``spark.checkpoint.dir``.
"""
