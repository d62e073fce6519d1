"""Reusable DataFrame operators: ranks, quantiles, bins, top-k."""
