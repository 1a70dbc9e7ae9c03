"""Readers, writers and integrity helpers."""
