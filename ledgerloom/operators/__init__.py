"""DataFrame-to-DataFrame steps: listing, HTML nodes, section boundaries, outcomes, spans."""
