"""Spark-native analytics over ordered, event-sourced operation logs."""
