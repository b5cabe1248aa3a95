"""DataFrame in, DataFrame out: the building blocks."""
