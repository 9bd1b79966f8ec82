"""Operators for the preparation of language-model data. Nothing else in the library imports this package."""
