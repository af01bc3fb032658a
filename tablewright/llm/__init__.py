"""Operators of a training-data pipeline, each a job on DataFrames."""
