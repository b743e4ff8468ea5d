"""Spark-native search and change analytics over collections of files and documents."""

__version__ = "0.1.0"
