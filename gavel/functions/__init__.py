"""Reusable column expressions and distributed building blocks."""
