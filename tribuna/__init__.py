"""Tribuna: a PySpark-native analytics engine for event seat inventories."""

__version__ = "0.1.0"
