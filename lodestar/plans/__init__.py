"""Lodestar: plans."""
