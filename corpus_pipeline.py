"""A training corpus from raw documents: rules, line dedup, near-dedup, decontamination and the mix of sources.

Each stage takes (spark, docs, sf_dir) and returns documents; all but the last keep the columns of documents. Stages
are written to the shared scratch folder and reread, so a lost executor costs one stage at most; a stage's table is
deleted once the next one is written.

Nulls: a null or empty text fails the quality rules; null languages and sources are values of their own; a null id orders
last, so its document goes where a copy has an id. Rows that repeat an id and text leave one row. Columns of any name are
carried along; the last stage's ``copy`` gets underscores until it differs from them. Empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontaminate, lines, mixing, quality, simhash
from tessella.llm.common import cut, discard, table

STAGES = [
    ("quality rules", quality.stage),
    ("line dedup", lines.stage),
    ("near-dedup", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("source mix", mixing.stage),
]
#: Fingerprints and divergences have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before is not None:
            discard(before)
        before = docs
    return docs
