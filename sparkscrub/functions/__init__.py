"""Scalar building blocks: Column in, Column out, no Python UDFs."""
