"""Training-data operators (url filters, quality, decontamination, sharding, WARC, PII, joins, dedup, BPE, secrets).

Nothing else in the package imports this subpackage; ``queries.py`` exposes the thin query per operator.
"""
