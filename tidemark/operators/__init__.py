"""Operators over series that give frames of another shape."""
