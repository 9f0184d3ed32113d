"""Extension: rolling portfolios over arriving days. Not part of the batch study."""
