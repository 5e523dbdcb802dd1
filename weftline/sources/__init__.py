"""Readers and sinks: tables in several formats, corpora, manifests, logs and speech indices."""
