"""Operators over action streams."""
