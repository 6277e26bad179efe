"""End-to-end batch job, test-data adapters and the query catalogue."""
