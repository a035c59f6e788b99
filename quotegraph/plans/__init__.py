"""Plan-level helpers: shared folders and written intermediate tables."""
