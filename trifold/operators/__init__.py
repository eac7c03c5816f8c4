"""Operators on DataFrames: alignment, diffs, graphs, state, whole-file merges."""
