"""Tables in and out: assays, fingerprints, rejects, requests, splits, results, models."""
