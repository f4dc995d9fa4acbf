"""Batched hybrid retrieval and incremental indexing expressed as Spark DataFrames."""

__version__ = "0.1.0"
