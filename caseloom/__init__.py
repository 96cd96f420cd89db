"""Incident evidence analytics on Spark."""
