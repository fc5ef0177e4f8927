"""DataFrame operators: preparation, ranks, fingerprints, sampling, metrics, trees."""
