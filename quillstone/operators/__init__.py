"""Operators over DataFrames: post-processing, extraction, layout, the store, and evaluation."""
