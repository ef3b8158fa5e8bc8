"""Readers and writers of the input and output tables."""
