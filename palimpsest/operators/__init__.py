"""Operators of the history search engine."""
