"""An analytics engine on Spark: a line-oriented query language, a fluent builder, and tables of Parquet segments."""

__version__ = "0.1.0"
