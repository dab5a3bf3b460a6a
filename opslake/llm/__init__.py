"""Operators for training data: extraction, near copies, private data, languages, toxicity, tokens and repeats."""
