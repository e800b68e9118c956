"""Continuous classification of arriving files."""
