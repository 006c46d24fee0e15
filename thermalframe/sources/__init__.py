"""Readers, writers and the sensor view."""
