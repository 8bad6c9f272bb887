"""Multi-model analytics on Spark DataFrames: SQL, wide-column, graph, RDF, search, time series."""
