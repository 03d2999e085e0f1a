"""Readers and writers: monthly CSV feed, catalog tables, derived fixtures."""
