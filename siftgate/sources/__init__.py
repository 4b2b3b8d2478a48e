"""Readers and writers: items, wordlists, blocklists, audit lines, reports."""
