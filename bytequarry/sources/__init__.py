"""Readers of artifacts and writers of bundles."""
