"""Exact batched Euclidean k-means and training-data operators on Spark DataFrames."""

__version__ = "0.1.0"
