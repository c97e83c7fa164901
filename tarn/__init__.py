"""Experiment and comparison analytics on Spark DataFrames."""
