"""Operators for large text collections. Nothing else in the package imports this folder."""
