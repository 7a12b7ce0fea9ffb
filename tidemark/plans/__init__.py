"""Plan shapes that keep series operators balanced when some series are huge."""
