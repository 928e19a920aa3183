"""Auditing analytics over source corpora on Spark DataFrames."""
