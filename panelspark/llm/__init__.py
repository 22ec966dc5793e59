"""Operators of a text-corpus pipeline: filtering, language, deduplication, tokens, shards, decontamination."""
