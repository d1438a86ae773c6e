"""Operators that prepare text and records for training corpora. Nothing else in lectern imports this."""
