"""Operators for training-data pipelines. Nothing outside this subpackage imports it.

Each ``opNN_*`` module holds one operator with a general interface and a thin
``query(spark, sf_dir)`` that applies it to its whole table with production
parameters.  ``registry`` collects the queries and their SQL.
"""
