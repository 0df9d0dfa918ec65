"""Proofreading of document collections as Spark DataFrames."""
