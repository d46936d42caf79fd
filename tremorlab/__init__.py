"""Spark-native analytics for calibrated large-move probabilities."""

__version__ = "0.1.0"
