"""Quire: a PySpark-native engine for document page routing and corpus preparation."""

__version__ = "0.1.0"
