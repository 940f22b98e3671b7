"""corvane: a Spark-native engine for text selection, dataset building and answer evaluation."""

__version__ = "0.1.0"
