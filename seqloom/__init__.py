"""Spark-native building, auditing and scoring of leak-free sequence-pair datasets."""
