"""Operators for preparing language-model training data, on Spark.

Nothing outside this subpackage imports it. Each ``opN_*`` module holds one
operator with a general interface; :mod:`brinewave.llm.catalog` registers the
thin queries and the SQL that goes with them.
"""
