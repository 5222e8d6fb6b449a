"""Operators over pixel relations (x, y, r, g, b, a) and selections (x, y, cov)."""
