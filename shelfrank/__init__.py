"""shelfrank: a Spark-native product-recommendation and catalog-analytics engine."""

__version__ = "0.1.0"
