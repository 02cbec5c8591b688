"""Rubrics over streams: stateless per document, so the batch expressions run unchanged."""
