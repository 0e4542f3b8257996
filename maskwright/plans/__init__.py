"""Whole plans: the facade, the registered queries and their SQL."""
