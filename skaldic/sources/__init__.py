"""Readers and writers of utterances, manifests, results, metadata and documentation headers."""
