"""Operators over event logs."""
