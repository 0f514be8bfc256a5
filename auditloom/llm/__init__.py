"""Operators that prepare text corpora for training and audits of language models."""
