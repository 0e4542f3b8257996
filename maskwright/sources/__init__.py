"""Readers that end in blocks, and writers of registries and reports."""
