"""Relational, temporal and spatial operators: functions from DataFrames to DataFrames."""
