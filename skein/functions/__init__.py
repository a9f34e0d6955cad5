"""Scalar expressions: Column -> Column, all built-in functions."""
