"""Declared-schema readers, typed writers and content manifests."""
