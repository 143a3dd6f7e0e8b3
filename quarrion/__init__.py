"""Spark-first catalogue analytics: filters, search, aggregation, enrichment,
entity resolution, provenance, quality metrics and streaming limits."""

__version__ = "0.1.0"
