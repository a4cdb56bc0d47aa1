"""Operators for training data: term frequencies, tokenizer encoding, evaluation leakage, wrong encodings."""
