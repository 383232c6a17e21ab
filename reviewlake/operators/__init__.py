"""Operators over change sets, reports, graphs and learned feedback."""
