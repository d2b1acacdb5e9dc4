"""Readers that turn stored tables and volumes into DataFrames."""
