"""Quality rules by distribution divergence.

Each document's histograms of character classes and of its language's common words are compared to the language's
reference by the Jensen-Shannon distance (base 2, 0 to 1). References are the sums over all documents of the language
that pass the base rules; the common words are its ``COMMON`` most frequent ones; the other words, and tokens with no
letter or digit, make up two more bins. A document without a reference for its language is compared to that of all
documents together. The divergence rules apply from ``LEAST_WORDS`` words on:
below, a histogram says too little.

Nulls: a null text has no words and fails the base rule; a null language is a language of its own, and so is an empty
one. Repeated rows are judged alike. An empty table gives an empty result. Any character may stand in words and
languages. Columns of any other name are carried inside one struct, so none can clash.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import WORD, ascii_lower, cut, discard

COMMON, LEAST_WORDS = 40, 20
#: Largest distances that a kept document of n words may have: a + b / sqrt(n), for the noise of a short histogram.
MOST_CLASSES, MOST_WORDS = (0.20, 0.9), (0.38, 1.0)
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOL = re.compile(r"[#*$%&|<>]")
HAS_LETTER, BARE = r"[\p{L}\p{N}]", re.compile(r"[\W_]+")
CLASSES = ["lower", "upper", "digit", "space", "symbol", "mark", "other"]
#: The reference of all documents; no language can have this key, as languages are strings or None.
ALL = ("all",)
#: Groups of tasks whose most frequent words are found first; the last step reads COMMON rows of each.
GROUPS = 8


def _class_table() -> np.ndarray:
    """Class of each code point under 65,536, by rule; the others count as other."""
    out = np.full(65536, 6, np.uint8)
    for c in range(0x2000):
        x = chr(c)
        if x in "\x20\t\n\x0b\x0c\r":
            out[c] = 3
        elif x in "#*$%&|<>":
            out[c] = 4
        elif x.isdigit():
            out[c] = 2
        elif x.isupper():
            out[c] = 1
        elif x.isalpha():
            out[c] = 0
        elif c < 0x300:
            out[c] = 5
    return out


TABLE = _class_table()


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(TABLE[np.minimum(points, 65535)], minlength=len(CLASSES))


def repeat_words(words: list[str]) -> int:
    """Words that lie in a window of 8 words found twice or more."""
    if len(words) <= WINDOW:
        return 0
    index: dict[str, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    for step in (1, 2, 4):  # numbers of runs of 2, 4 and 8 words
        found, ids = np.unique(ids[:-step] * (ids.max() + 1) + ids[step:], return_inverse=True)
        if len(found) == len(ids):  # no shorter run comes twice
            return 0
    twice = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(ids)] += twice
    edge[WINDOW : WINDOW + len(ids)] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def dup_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif WORD.search(line):
            seen.add(line)
    return n


def fails(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words


def base(text: str, words: list[str]) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and whether they fail the base rule."""
    n, again = len(words), repeat_words(words)
    return n, sum(map(len, words)), len(SYMBOL.findall(text)), dup_lines(text), again, fails(n, again)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, base 2."""
    p, q = p / max(p.sum(), 1e-300), q / max(q.sum(), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = sum(np.where(x > 0, x * np.log2(x / m), 0).sum() for x in (p, q)) / 2
    return float(np.sqrt(min(max(d, 0.0), 1.0)))


def references(docs: DataFrame, lang_col="lang", text_col="text") -> dict:
    """{language: {"classes": counts, "words": {word: count}, "total": words, "bare": tokens}}: a few dozen numbers for each language."""

    def count(batches):
        for pdf in batches:
            sums: dict = {}
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                words = WORD.findall(text or "")
                if fails(len(words), repeat_words(words)):
                    continue
                got = sums.setdefault(lang, [np.zeros(len(CLASSES), np.int64), Counter()])
                got[0] += classes(text)
                got[1].update(words)
            for lang, (kinds, cased) in sums.items():
                words = Counter()
                for w, n in cased.items():
                    words[ascii_lower(w)] += n
                yield pd.DataFrame({"lang": pd.Series([lang] * len(kinds), dtype=object), "class": np.arange(len(kinds), dtype=np.int32), "word": None, "n": kinds})
                yield pd.DataFrame({"lang": pd.Series([lang] * len(words), dtype=object), "class": np.full(len(words), -1, np.int32), "word": list(words), "n": list(words.values())})

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counted = rows.mapInPandas(count, "lang string, class int, word string, n long")
    sums = cut(counted.groupBy("lang", "class", "word").agg(F.sum("n").alias("n")), "quality-counts")
    whole = sums.groupBy("class", "word").agg(F.sum("n").alias("n")).select(F.lit(True).alias("every"), F.lit(None).cast("string").alias("lang"), "class", "word", "n")
    both = sums.select(F.lit(False).alias("every"), "lang", "class", "word", "n").unionByName(whole)
    words = both.where(F.col("class") < 0).drop("class")
    top = words.where(F.col("word").rlike(HAS_LETTER)).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    for part in (["part"], []):  # each task's most frequent words meet by groups of tasks first
        rank = F.row_number().over(Window.partitionBy("every", "lang", *part).orderBy(F.desc("n"), "word"))
        top = top.withColumn("rank", rank).where(F.col("rank") <= COMMON)
    letters = F.sum(F.when(~F.col("word").rlike(HAS_LETTER), F.col("n")).otherwise(0))
    totals = words.groupBy("every", "lang").agg(F.sum("n").alias("total"), letters.alias("bare"))
    out: dict = {}
    for r in totals.collect():  # a row a language
        out[ALL if r.every else r.lang] = {"classes": np.zeros(len(CLASSES), np.int64), "words": {}, "total": r.total, "bare": r.bare}
    for r in both.where(F.col("class") >= 0).collect():  # a row a language and class
        out[ALL if r.every else r.lang]["classes"][r["class"]] = r.n
    for r in top.orderBy("every", "lang", "rank").collect():  # COMMON rows a language
        out[ALL if r.every else r.lang]["words"][r.word] = r.n
    discard(sums)
    return out


def judge(text: str | None, lang: str | None, refs: dict) -> tuple:
    """Base values, base_failed, the two distances and kept of one document."""
    text = text or ""
    words = WORD.findall(text)
    *values, failed = base(text, words)
    ref = refs.get(lang) or refs.get(ALL)
    if not words or ref is None:
        return *values, failed, None, None, not failed
    by_class = js_distance(classes(text).astype(float), ref["classes"].astype(float))
    common = ref["words"]
    got, bare = Counter(), 0
    for w, n in Counter(words).items():
        if (low := ascii_lower(w)) in common:
            got[low] += n
        elif BARE.fullmatch(w):
            bare += n
    p = np.array([got[w] for w in common] + [len(words) - got.total() - bare, bare], float)
    q = np.array([*common.values(), ref["total"] - sum(common.values()) - ref["bare"], ref["bare"]], float)
    by_word = js_distance(p, q)
    most = [a + b / len(words) ** 0.5 for a, b in (MOST_CLASSES, MOST_WORDS)]
    far = len(words) >= LEAST_WORDS and (by_class > most[0] or by_word > most[1])
    return *values, failed, by_class, by_word, not failed and not far


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"


def rate(docs: DataFrame, lang_col="lang", text_col="text", refs: dict | None = None) -> DataFrame:
    """(doc, rated): each row of ``docs`` as a struct, and its base values, distances and verdict."""
    refs = references(docs, lang_col, text_col) if refs is None else refs

    @F.pandas_udf(SCHEMA)
    def rated(text: pd.Series, lang: pd.Series) -> pd.DataFrame:
        rows = [judge(t, x, refs) for t, x in zip(text, lang, strict=True)]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.struct(*docs.columns).alias("doc"), rated(F.col(text_col), F.col(lang_col).cast("string")).alias("rated"))


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rate(docs.select("doc_id", "lang", "text")).select("doc.doc_id", "rated.*")


def stage(spark, docs, sf_dir):
    """Documents that the rules keep."""
    return rate(docs).where("rated.kept").select(*(F.col("doc")[c].alias(c) for c in docs.columns))
