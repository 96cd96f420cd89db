"""Reusable dataframe operators."""
