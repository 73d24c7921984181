"""Schemas, table readers, configuration and file formats."""
