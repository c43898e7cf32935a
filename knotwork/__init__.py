"""A property-graph analytics engine that compiles a text language to Spark DataFrames."""

__version__ = "0.1.0"
