"""Baseline-homogeneity screening and corpus work on Spark DataFrames."""

__version__ = "0.1.0"
