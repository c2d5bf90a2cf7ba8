"""Operators for building language-model training data from Spark tables.

Nothing outside this package imports it; remove the folder and the rest of the
library still works.
"""
