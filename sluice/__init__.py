"""sluice: web pages and text corpora as versioned tables, built on Spark DataFrames."""

__version__ = "0.1.0"
