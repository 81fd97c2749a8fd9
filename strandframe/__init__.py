"""Spark-native analytics for bidirected sequence graphs and the linkage data that goes with them."""
