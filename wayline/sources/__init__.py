"""Readers: files and texts to the common schemas."""
