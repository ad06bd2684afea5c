"""Readers that fail on bad input."""
