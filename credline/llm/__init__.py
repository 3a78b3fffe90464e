"""Operators of a training-data pipeline (secrets, de-duplication, WARC, decontamination,
packing, language, personal data, vector search, toxicity). Nothing outside this
subpackage imports it; ``queries`` registers one query per operator."""
