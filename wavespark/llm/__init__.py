"""Operators for training-data pipelines; nothing else of the library imports this subpackage."""
