"""Claim analytics over page snapshots as Spark DataFrames."""
