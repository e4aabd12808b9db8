"""DataFrame to DataFrame operators on graphs, partitions and clusterings."""
