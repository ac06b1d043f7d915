"""Operators on variant objects and their payloads."""
