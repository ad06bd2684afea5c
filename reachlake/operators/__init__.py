"""Operators over fact tables: merge, reachability, components, classification, aggregation, comparison."""
