"""fieldloom: gridded-series reductions and ensemble analytics as Spark jobs."""
