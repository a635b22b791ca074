"""Relational operators over city-map, dialogue, trajectory and evaluation tables."""
