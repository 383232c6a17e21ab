"""Whole reviews, their renderings and the tool surface."""
