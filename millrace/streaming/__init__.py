"""Streams into layers."""
