"""Operators for large training-data pipelines; nothing else in quarry imports this subpackage."""
