"""The analyses. Each takes a ``Table`` or a result DataFrame and returns a lazy DataFrame."""
