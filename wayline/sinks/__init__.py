"""Writers. Track and subtitle files are made of ordered pieces, never one huge value."""
