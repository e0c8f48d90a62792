"""Relational operators over episode frames."""
