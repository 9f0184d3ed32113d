"""Configurations, checks and batched numerical kernels."""
