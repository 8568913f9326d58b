"""Column functions: hashing, text decoding, keys and identifiers."""
