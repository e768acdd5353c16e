"""Claim-graph analytics on Spark DataFrames."""
