"""Retail analytics as Spark jobs: ingest, treat, audit, profile and report."""
