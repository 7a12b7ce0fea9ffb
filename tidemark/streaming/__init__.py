"""Streaming operators: adaptive threshold, causal features, frozen scoring, gap filling."""
