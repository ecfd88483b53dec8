"""Training-data operators: dedup, joins, quality, language, PII, HTML extraction, mixing and packing."""
