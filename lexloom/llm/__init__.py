"""Operators for training-data pipelines over ``documents``; nothing else in the package imports them."""
