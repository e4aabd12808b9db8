"""Registered queries, partitioning schemes, presets."""
