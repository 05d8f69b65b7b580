"""Ownership-transfer analytics as lazy Spark DataFrame plans."""
