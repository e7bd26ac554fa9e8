"""Readers that give text tables with a source order."""
