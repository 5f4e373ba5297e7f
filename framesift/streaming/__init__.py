"""Logs that keep arriving."""
