"""Whole queries and graph patterns."""
