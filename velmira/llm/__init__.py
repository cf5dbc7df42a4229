"""Operators for training-data work on text; nothing else in the library imports this subpackage."""
