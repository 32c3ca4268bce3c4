"""SQL faces of the queries, the clustering study, serving rows, sinks and the benchmark harness."""
