"""Readers and writers of score sheets, manifests and reports."""
