"""DataFrame operators: patterns, vectors, facts, sets, reads, analytics."""
