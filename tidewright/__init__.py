"""Tidewright: dataset curation and evaluation analytics as Spark programs."""

__version__ = "0.1.0"
