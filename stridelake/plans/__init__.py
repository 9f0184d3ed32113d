"""Whole studies: backtests, bootstrap workloads, reports, and the catalogue of queries."""
