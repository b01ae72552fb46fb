"""Lodestar: operators."""
