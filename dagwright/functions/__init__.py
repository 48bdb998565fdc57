"""Numeric kernels: tail probabilities and regressions."""
