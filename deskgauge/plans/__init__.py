"""The analyses a user runs, as compositions of the operators."""
