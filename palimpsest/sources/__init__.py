"""Readers and writers of the formats the engine takes in."""
