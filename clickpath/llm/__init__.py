"""Operators for training-data preparation on Spark.

Every operator takes DataFrames and returns a DataFrame. Nothing outside this
subpackage imports it; ``queries.py`` registers one query per operator.
"""
