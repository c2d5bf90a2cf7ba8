"""Element tables, geometry, tags and triples of open map data on Spark."""
