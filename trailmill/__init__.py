"""Trajectory preparation and analytics as PySpark DataFrame plans."""
