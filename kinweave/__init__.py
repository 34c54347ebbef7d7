"""kinweave: record linkage, data quality and cleaning verbs for Spark DataFrames."""

__version__ = "0.1.0"
