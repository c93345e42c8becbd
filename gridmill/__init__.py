"""Spark-native analytics over corpora of structured tables, with operators for training-data pipelines."""
