"""A Spark-native analytics engine: query shapes and semantics on DataFrames, run by Catalyst."""
