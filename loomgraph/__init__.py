"""A PySpark-native text-graph analytics engine."""

__version__ = "0.1.0"
