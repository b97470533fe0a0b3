"""Training-data operators: archives, chat formatting, joins, packing, scans,
language and toxicity models, line dedup, fingerprints, decontamination."""
