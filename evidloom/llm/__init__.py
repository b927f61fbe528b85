"""Operators for preparing large text collections for model training.

Nothing else in the library imports this package; ``__spark_entry__`` adds its queries when it
is present.
"""
