"""Operators for preparing text corpora at scale, one module each; nothing else in the library imports them."""
