"""Byte-artifact analysis on Spark: tables of artifacts in, tables of evidence out."""
