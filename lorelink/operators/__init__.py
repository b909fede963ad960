"""Operators over requests, links and the knowledge base's relations."""
