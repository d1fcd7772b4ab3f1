"""Partitioned writers for sections, metadata, failures and raw documents."""
