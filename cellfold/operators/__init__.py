"""Joins and aggregations of hazards with gridded counts."""
