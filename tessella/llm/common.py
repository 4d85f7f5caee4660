"""What the corpus operators share: words, scratch tables and table access."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.scratch import cut, discard, scratch_root

__all__ = ["WORD", "WORD_SQL", "ascii_lower", "cut", "discard", "n_words", "scratch_root", "table"]

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and return.
WORD_SQL = r"[^\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = re.compile(r"[A-Z]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: str) -> str:
    """A-Z to a-z; every other character stays."""
    return text.lower() if text.isascii() else _UPPER.sub(lambda m: m[0].lower(), text)


def n_words(text: Column) -> Column:
    """Number of words: each becomes one letter, and letters are counted, so no array of words is made."""
    marks = F.regexp_replace(text, WORD_SQL, "x")
    return F.coalesce(F.octet_length(marks) - F.octet_length(F.replace(marks, F.lit("x"), F.lit(""))), F.lit(0)).cast("long")
