"""Readers, writers and the projection of the driver's tables onto the knowledge base's."""
