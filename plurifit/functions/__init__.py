"""Column functions: hashed keys, scalar helpers and size-checked frames."""
