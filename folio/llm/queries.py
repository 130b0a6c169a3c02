"""The corpus operators' queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from . import bitplanes, decontaminate, hard_negatives, line_dedup, lm_score, mixing, near_dup, repetition, runs, secrets, toxicity, url_filter, warc

_MODULES = [repetition, toxicity, warc, decontaminate, near_dup, line_dedup, mixing, url_filter, lm_score, secrets, runs, bitplanes, hard_negatives]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: q for m in _MODULES for k, q in m.ORACLE.items()}
