"""Document operators on line and node tables."""
