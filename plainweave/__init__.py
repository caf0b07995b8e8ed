"""Spark-first text complexity engine."""
