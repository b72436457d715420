"""Claim-versus-measurement analytics on Spark DataFrames."""
