"""A Spark-native price-intelligence engine."""
