"""Readers of the files that collection leaves behind."""
