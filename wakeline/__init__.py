"""Trajectory anomaly analytics, Spark-first."""
