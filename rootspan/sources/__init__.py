"""Readers and writers: triple text, dictionaries, placed triples, statistics."""
