"""Readers and writers for item, feedback, dictionary, vector and model files."""
