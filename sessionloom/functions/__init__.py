"""Column-level functions: scalars, keyed randomness, distribution expressions."""
