"""Readers, writers and the access log derived from an event table."""
