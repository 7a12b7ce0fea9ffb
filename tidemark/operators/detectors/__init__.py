"""Detectors: ``fit`` is a distributed aggregate that returns a small artifact, ``score``
is a map over rows or windows.  Every score is higher for a more anomalous row."""
