"""Hierarchical clustering of units that have features and a place on the map, on Spark."""
