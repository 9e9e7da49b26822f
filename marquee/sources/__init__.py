"""Sources of the listing engine."""
