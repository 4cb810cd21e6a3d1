"""Causeway: a PySpark-native engine for causal structure in large panels of time series."""
