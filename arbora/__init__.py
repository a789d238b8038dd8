"""Vessel-network analytics as lazy Spark DataFrame operators."""
