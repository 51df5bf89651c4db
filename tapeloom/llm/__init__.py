"""Operators for preparing training text: each takes and gives DataFrames; nothing else in the library imports them."""
