"""Operators for large text corpora; each module holds one operator and the thin query over it."""
