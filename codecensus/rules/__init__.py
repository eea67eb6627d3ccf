"""Fixed rule tables."""
