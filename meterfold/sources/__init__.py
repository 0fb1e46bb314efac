"""Declared schemas, lake layout, readers and writers."""
