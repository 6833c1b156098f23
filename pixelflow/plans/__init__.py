"""Query catalog."""
