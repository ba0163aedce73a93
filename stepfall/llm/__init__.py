"""Operators for training-data corpora: quality, mixing, duplicates, language, tokens, personal data, chat, toxicity."""
