"""Corpus operators: filters, de-duplication, sampling, splits, annotation and metrics as DataFrame plans."""
