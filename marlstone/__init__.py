"""marlstone: a Spark-native analytics engine over code evidence tables."""

__version__ = "0.1.0"
