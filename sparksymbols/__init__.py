"""Symbol tables over large file collections, computed with Spark DataFrames and streams."""

__version__ = "0.1.0"
