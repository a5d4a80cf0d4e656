"""Spark-native attribution of single trading decisions."""
