"""Impact analysis of typed dependency graphs, and section search over prose, on Spark."""
