"""Column-level functions: cleaning, normalising and hashing."""
