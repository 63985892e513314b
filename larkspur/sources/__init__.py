"""Landed payloads to listings."""
