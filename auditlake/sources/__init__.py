"""Readers and writers of package files and documents."""
