"""Report measures, the query catalogue and its SQL oracles."""
