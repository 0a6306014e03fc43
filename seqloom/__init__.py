"""seqloom: sequence-overlap and assembly-graph analytics on Spark DataFrames."""
