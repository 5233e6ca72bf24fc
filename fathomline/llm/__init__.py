"""Training-data operators; their queries and SQL twins are in ``queries``. Nothing outside imports this package."""
