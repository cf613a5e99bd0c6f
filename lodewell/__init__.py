"""lodewell: retrieval, code-graph and corpus-preparation operators expressed as Spark DataFrames."""

__version__ = "0.1.0"
