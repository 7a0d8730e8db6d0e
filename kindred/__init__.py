"""A Spark-native engine for similarity matching and entity resolution."""
