"""Column functions: text, clamps, hashes, image headers."""
