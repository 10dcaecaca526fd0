"""Relational operators of late-interaction retrieval and its evaluation."""
