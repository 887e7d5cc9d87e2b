"""Interval, conversation and text analytics on Spark DataFrames."""
