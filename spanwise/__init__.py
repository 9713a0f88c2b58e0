"""Spark-native operators for ordered signals, scored frames and event intervals."""
