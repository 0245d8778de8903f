"""Operators for preparing text corpora; nothing outside this folder needs it."""
