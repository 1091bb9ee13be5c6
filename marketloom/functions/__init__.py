"""Numeric functions that run inside grouped or batched Python functions."""
