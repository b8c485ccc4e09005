"""citeloom: record linkage, graph, vector and text analytics on PySpark DataFrames."""
