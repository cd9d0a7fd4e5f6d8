"""Column functions: text, sets, vectors, time, hashing and control parameters."""
