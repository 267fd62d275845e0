"""Operators that prepare a text corpus for language-model training.

Nothing outside this subpackage and ``corpus_pipeline.py`` imports it.
"""
