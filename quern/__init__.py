"""Typed nested records as DataFrames: schema, presence, diff and patch, codecs, routing, streams."""
