"""Normalising sources, and sinks."""
