"""Page-directory sources, sinks and lookups."""
