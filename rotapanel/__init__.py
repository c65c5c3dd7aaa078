"""Rotating-panel survey analysis on Spark DataFrames."""
