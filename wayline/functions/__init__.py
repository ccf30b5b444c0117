"""Scalar functions, all built from native Column expressions."""
