"""Readers of term lists, corpora, delimited and labelled sources; artifact checks; a JSON sink."""
