"""Composed analyses over several operators."""
