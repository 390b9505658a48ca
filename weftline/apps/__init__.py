"""Cells of some domains."""
