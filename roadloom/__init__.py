"""Analytics over graphs, road-network partitions and geospatial tables as Spark transformations."""
