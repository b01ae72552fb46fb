"""Lodestar: streaming."""
