"""Readers, writers and catalogue registration."""
