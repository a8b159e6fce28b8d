"""lumenscan: a Spark-native retrieval and data-processing engine."""

__version__ = "0.1.0"
