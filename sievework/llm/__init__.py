"""Training-data operators: filtering, near-duplicate search, decontamination, privacy and packing.

Nothing outside this subpackage imports it.
"""
