"""Readers, writers and compute-once tables."""
