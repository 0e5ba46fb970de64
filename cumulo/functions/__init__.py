"""Column expressions: hashing, lattice arithmetic, error formulas."""
