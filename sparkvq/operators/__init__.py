"""DataFrame operators: search, index, metrics, attention."""
