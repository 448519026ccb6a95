"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and encoding, each over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartloom.llm import op1_mixing, op4_bpe, op5_quality, op6_near_dups, op8_line_dedup
from cartloom.llm.common import read, written

#: (name, function); a function takes (spark, docs, sf_dir). All but the last return the columns of documents.
STAGES = [
    ("quality_rules", op5_quality.stage),
    ("line_dedup", op8_line_dedup.stage),
    ("minhash_near_dedup", op6_near_dups.stage),
    ("mix_sources", op1_mixing.stage),
    ("bpe_encode", op4_bpe.stage),
]

#: The field's training, sketches and merges have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is written and read again as the next one's input."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
