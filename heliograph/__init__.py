"""Heliograph: sky catalogues and training-data pipelines on Spark DataFrames."""
