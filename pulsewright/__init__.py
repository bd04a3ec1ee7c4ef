"""Pulsar-timing data curation as Spark DataFrame jobs."""
