"""A Spark-native analytics engine over a versioned key/value log."""
