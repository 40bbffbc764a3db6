"""motifmill: motif enrichment analytics on Spark DataFrames."""
