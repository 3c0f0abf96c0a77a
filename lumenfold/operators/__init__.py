"""Part of the time-series engine; see README."""
