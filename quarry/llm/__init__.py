"""Training-data operators: dedup, language, licences, decontamination, sharding, packing, scoring, joins and search."""
