"""lanegraph: ship-route analytics over a directed, weighted network of sea cells, on PySpark."""
