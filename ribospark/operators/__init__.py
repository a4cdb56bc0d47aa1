"""Data-processing operators: plain functions from DataFrames to DataFrames."""
