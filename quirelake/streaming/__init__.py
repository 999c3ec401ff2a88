"""Growing directories and event streams."""
