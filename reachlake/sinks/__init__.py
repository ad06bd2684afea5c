"""Deterministic documents from result tables."""
