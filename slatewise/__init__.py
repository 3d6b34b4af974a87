"""Spark-native analytics over impressions, reading histories, articles and embeddings."""
