"""Operators over DataFrames: index, search, statistics, frontier."""
