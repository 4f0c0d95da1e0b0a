"""The same operators on live data."""
