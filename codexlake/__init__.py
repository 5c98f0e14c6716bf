"""Scholarly-corpus analytics on Spark: DataFrame operators, sources, functions and pipelines."""
