"""Anomaly detection and evaluation over keyed time series, on Spark DataFrames."""

from tidemark.spec import SeriesSpec

__all__ = ["SeriesSpec"]
