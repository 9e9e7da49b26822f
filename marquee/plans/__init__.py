"""Plans of the listing engine."""
