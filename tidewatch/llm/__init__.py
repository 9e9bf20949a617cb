"""Operators over free text and records for training data; nothing else in the library imports this package."""
