"""Path analytics on heterogeneous graphs, declared on Spark DataFrames."""
