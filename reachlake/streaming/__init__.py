"""Incremental and streaming ingestion of fact batches."""
