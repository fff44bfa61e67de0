"""Readers and writers of registry data."""
