"""Operators for training data: fingerprints, personal data, toxicity, vector search, tokens, URLs, chats, pages, packing, near copies."""
