"""Motif analytics on Spark: sequences, motifs, hits and statistics as DataFrames."""
