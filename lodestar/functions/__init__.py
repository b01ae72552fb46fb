"""Lodestar: functions."""
