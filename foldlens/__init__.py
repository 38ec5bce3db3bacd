"""foldlens: Spark-native auditing of classification results and of the data behind them."""

__version__ = "0.3.0"
