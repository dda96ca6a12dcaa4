"""Readers: delimited text, parquet, SQL dumps, extracted cell grids, table sets."""
