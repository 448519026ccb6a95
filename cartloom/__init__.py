"""Commerce identity analytics as PySpark jobs: URL identity, event normalisation, cart enrichment, reports."""
