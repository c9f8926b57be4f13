"""Operators for training data: near duplicates, shared spans, co-occurrence, tokens, leakage, look-alikes."""
