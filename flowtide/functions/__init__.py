"""Scalar helpers: column expressions and driver-side name resolution."""
