"""Iterative graph algorithms on edge DataFrames."""
