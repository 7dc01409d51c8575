"""Operators put together into whole flows."""
