"""Registered queries of the subpackage and the SQL that some are checked against."""

from __future__ import annotations

import corpus_pipeline
from cartloom.llm import (
    op1_mixing,
    op2_suffix_arrays,
    op3_substrings,
    op4_bpe,
    op5_quality,
    op6_near_dups,
    op7_surrogates,
    op8_line_dedup,
    op9_topk,
    op10_warc,
    op11_clusters,
    op12_periodic_runs,
    op13_token_files,
)

_PARTS = (
    op1_mixing,
    op2_suffix_arrays,
    op3_substrings,
    op4_bpe,
    op5_quality,
    op6_near_dups,
    op7_surrogates,
    op8_line_dedup,
    op9_topk,
    op10_warc,
    op11_clusters,
    op12_periodic_runs,
    op13_token_files,
)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
ORACLE = {name: text for part in _PARTS for name, text in part.ORACLE.items()}
