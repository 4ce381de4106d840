"""Readers and writers with the contracts of the curation workflow."""
