"""Cleaning, profiling and table operators."""
