"""Relational operators on panels, windows, portfolios and resamples."""
