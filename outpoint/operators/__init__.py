"""Table operators: joins, aggregations, ordering, chain and Merkle work."""
