"""Additive-effect models and profiles of large rating logs, on Spark DataFrames."""
