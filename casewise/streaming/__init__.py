"""Arrival of quarters as a file stream."""
