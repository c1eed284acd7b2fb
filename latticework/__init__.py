"""Graph search, edge-table analytics and their reports on Spark DataFrames."""

__version__ = "0.1.0"
