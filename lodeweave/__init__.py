"""Lexical retrieval, temporal knowledge graphs and corpus preparation on Spark."""

__version__ = "0.1.0"
