"""Cells, their combinators and contracts."""
