"""Validated descriptions of what to compute. Driver side only, no data."""
