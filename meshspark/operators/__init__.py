"""Graph operators: supersteps, algorithms, partitioning."""
