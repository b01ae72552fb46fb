"""Lodestar: a Spark-native rule reasoner over triples held as DataFrames."""
