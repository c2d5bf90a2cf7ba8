"""Readers of element data."""
