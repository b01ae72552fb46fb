"""Lodestar: sources."""
