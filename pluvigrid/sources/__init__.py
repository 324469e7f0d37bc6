"""Readers and writers for raw readings, processed tables and models."""
