"""Operators over DataFrames: fuzzy lookup, verification, routing, upserts, validation, types, images."""
