"""Scalar, statistical and rank expressions."""
