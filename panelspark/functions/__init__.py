"""Column-expression helpers (no shuffles, no actions)."""
