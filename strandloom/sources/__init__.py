"""Readers and writers of sequence, annotation, link, find and structure files."""
