"""Composite jobs: reports, daily enrichment, maintenance, full run."""
