"""Readers: company registry, submission documents, landed filing documents."""
