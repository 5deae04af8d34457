"""Spark-native vector quantization and compressed similarity search."""
