"""Serialisation and writers."""
