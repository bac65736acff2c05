"""readloom: a Spark-native engine for sequencing-read analytics."""

__version__ = "0.1.0"
