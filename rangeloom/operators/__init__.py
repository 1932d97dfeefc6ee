"""Operators on range sets."""
