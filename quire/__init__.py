"""Corpus engine on Spark: tokens, selectors, searches, reports, rewrites and versions of marked-up text as DataFrames."""
