"""Spark-first analytics for indoor and outdoor wayfinding data."""
