"""Operators on position reports, transitions and scores."""
