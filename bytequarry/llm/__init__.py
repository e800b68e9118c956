"""Training-data operators: fingerprints, mixing, token output, media columns,
near-duplicates, personal data, packing, quality, suffix arrays and web archives.

Nothing else in the library imports this subpackage.
"""
