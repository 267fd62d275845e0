"""Functions of the history search engine."""
