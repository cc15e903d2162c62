"""Readers of raw files and writers of result tables."""
