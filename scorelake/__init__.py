"""Spark-native scoring of vector tables and analytics over the runs that score them."""

__version__ = "0.1.0"
