"""Vitrine: search, browse, profile and ingest collections as Spark jobs."""
