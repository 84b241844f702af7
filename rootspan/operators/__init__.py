"""Relational and iterative operators over triples, edges and start sets."""
