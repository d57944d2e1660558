"""larkspur: retrieval, graph, temporal and dataset analytics as PySpark DataFrame operators."""
