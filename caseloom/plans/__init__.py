"""Correlation builders and analyst queries."""
