"""Training-data pipeline operators: licences, packing, PII, decontamination, near-duplicates,
toxicity, chat formatting, secrets and language identification.

Nothing outside this subpackage imports it.
"""
