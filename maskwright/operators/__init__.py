"""Operators on blocks and fields."""
