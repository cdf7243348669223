"""Cliploom: a Spark-native engine for collections of short signal clips."""

__version__ = "0.1.0"
