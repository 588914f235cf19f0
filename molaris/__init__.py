"""Rule-driven screening reports on Spark: ingest, derive, score, report, follow up."""
