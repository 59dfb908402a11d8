"""Readers, writers, and storage of models and settings."""
