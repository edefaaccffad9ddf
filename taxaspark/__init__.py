"""Specimen-collection search, similarity and enrichment on Spark DataFrames."""
