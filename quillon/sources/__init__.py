"""Readers and writers of the file formats of retrieval test collections."""
