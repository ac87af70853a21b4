"""Scalar and ordering helpers."""
