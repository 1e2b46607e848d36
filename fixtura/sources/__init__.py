"""Readers and writers: delimited files with provenance, JSON envelopes, manual signal files, append-only logs."""
