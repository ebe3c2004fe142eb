"""Flat files, descriptors and packet streams."""
