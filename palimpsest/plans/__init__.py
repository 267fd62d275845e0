"""Plans of the history search engine."""
