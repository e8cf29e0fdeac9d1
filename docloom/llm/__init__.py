"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, keeps its own columns plus what it adds, and writes intermediate
tables only below the folder named by ``spark.checkpoint.dir``.
"""
