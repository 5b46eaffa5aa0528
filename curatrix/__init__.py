"""Curation of text-and-metadata training datasets on Spark DataFrames."""
