"""Evaluation-data audit and analytics on Spark DataFrames."""
