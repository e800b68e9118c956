"""Relational operators over artifacts, records and evidence."""
