"""Whole reports composed of operators."""
