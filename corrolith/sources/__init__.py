"""Readers of session files and seed bundles, and providers of replies and vectors."""
