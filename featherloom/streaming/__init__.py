"""Profiles that are kept up to date over a stream."""
