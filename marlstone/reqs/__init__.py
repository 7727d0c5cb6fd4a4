"""Requirement trees: reading, scoring, assembling and judging them."""
