"""Column-level helpers: exact money aggregates, time features, bin arithmetic."""
