"""Registered queries and whole programs, put together from operators."""
