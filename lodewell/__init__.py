"""lodewell: recall, graph, temporal and corpus analytics expressed with PySpark DataFrames."""
