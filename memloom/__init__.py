"""memloom: a PySpark-native engine for associative graph memory and the data work around it."""

__version__ = "0.1.0"
