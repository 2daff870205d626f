"""Spark-native analytics for georeferenced field-sensor data."""
