"""Recommendation-data preparation and ranking evaluation on Spark DataFrames."""

__version__ = "0.1.0"
