"""Operators for streams."""
