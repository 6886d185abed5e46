"""Operators over event streams, and their batch twins."""
