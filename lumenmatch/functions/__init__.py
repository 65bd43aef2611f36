"""Column functions: text, hashes, geometry."""
