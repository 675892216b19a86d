"""Operators for large training-data collections; nothing outside this folder imports them."""
