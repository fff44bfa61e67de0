"""A Spark-native engine for list screening and registry analytics."""
