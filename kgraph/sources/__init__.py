"""Scans, sinks, upserts and fingerprints."""
