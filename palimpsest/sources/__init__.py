"""Sources of the history search engine."""
