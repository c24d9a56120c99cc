"""Data-processing operators (DataFrame in, DataFrame out)."""
