"""Operators for building and checking training data."""
