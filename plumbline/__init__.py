"""Plumbline: column profiling, foreign-key discovery and TTL key-value logs on Spark DataFrames."""

from plumbline.config import ColumnSpec, Limits, specs_from_schema

__all__ = ["ColumnSpec", "Limits", "specs_from_schema"]
