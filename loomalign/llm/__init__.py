"""Operators of a training-data pipeline: scanning, cleaning, deduplication, decontamination, packing and sharding.

Nothing outside this subpackage imports it.
"""
