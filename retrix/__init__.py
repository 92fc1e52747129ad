"""retrix: a PySpark-native retrieval and knowledge analytics engine."""

__version__ = "0.1.0"
