"""Scalar functions as column expressions, and small helpers for what columns cannot say."""
