"""Streaming of the history search engine."""
