"""Batch operators on files that keep arriving."""
