"""Plan shapes for skewed joins, top-k, and reused results."""
