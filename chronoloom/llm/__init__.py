"""Operators for language-model data: quantile sketches, tokenization, leaked test items, cut texts."""
