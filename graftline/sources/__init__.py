"""Readers and writers of sequence, alignment and table files."""
