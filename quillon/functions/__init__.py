"""Column functions: vectors, codecs, hashes."""
