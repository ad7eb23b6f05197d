"""DataFrame operators: predicates, aggregation, slots, values, heatmaps."""
