"""tesselon: Spark-native analytics over the full edit history of map data."""
