"""Readers, writers and the test-table adapters."""
