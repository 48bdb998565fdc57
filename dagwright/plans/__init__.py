"""Searches: what is driver-side is as large as the number of variables, never as the data."""
