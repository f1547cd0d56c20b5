"""lodestar: a Spark-native engine for identity search, evaluation and detection analytics."""

__version__ = "0.1.0"
