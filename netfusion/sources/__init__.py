"""Readers, schema detection and mapping for heterogeneous record files."""
