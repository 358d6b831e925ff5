"""Regulatory record jobs on Spark DataFrames."""
