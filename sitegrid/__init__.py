"""Spatial-network coverage and plan auditing on Spark tables."""
