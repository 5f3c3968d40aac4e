"""Readers and writers of framed records, text and JSON."""
