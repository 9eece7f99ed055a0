"""Declarative batch data jobs on Spark: standard transformations, SQL, governed reads and writes, and connectors."""

__version__ = "0.1.0"
