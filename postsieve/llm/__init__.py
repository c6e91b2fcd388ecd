"""Operators over large text collections for model training data."""
