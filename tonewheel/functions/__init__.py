"""Column expressions and reusable distributed primitives."""
