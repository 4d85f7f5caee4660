"""Toxicity by a character n-gram classifier on naive Bayes log-count ratios.

A text's features are the character n-grams (n = 3, 4, 5, white space as single blanks, A-Z lower-cased) that it holds,
hashed into 2^20 bins and counted once each. Features that tell the labels apart by chance alone are left out: kept are
those in ``LEAST_DOCS`` texts or more whose number among label 1 is some standard deviations off. A feature's value is its
log-count ratio, the log of its smoothed share of documents of label 1 over that of label 0; a logistic regression on
these values gives the score. How many deviations, and the penalty on the weights, are those of ``CHOICES`` with the least
logarithmic loss over ``PARTS`` folds inside the training rows.

The classifier is fitted on at most ``SAMPLE`` labelled rows, those with the least hash of their id and one text for each
id: one task, whatever the size of the corpus. Rows of the held-out fold, and rows without a label, are never learnt from;
labels, lang, source and ids are no inputs of a score. Every document is scored, over its whole text, with a table of
fixed size.

Nulls: a null text is an empty one and scores the bare intercept; a null id is in no fold but the first (crc32 of
nothing counts 0, so it is held out). Several labels of one id count as their largest, of several texts the one with the
least hash is learnt from. Without labels of both kinds every score is 0. Repeated rows score alike. An empty table gives
an empty result. Columns of any other name are carried inside one struct, so none can clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import ascii_lower

ORDERS, BITS, SAMPLE, FOLDS = (3, 4, 5), 20, 8000, 5
SMOOTH, LEAST_DOCS, STEPS, PARTS = 0.5, 4, 150, 3
#: Deviations that a feature is kept from, and penalties.
CHOICES = [(z, penalty) for z in (4.0, 5.0, 6.0) for penalty in (1e-4, 1e-3)]
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACES = str.maketrans("\t\n\x0b\x0c\r", "     ")


class Features:
    """Distinct n-gram bins of a text; keeps a work table between calls."""

    def __init__(self):
        self.stamp = np.zeros(1 << BITS, np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        text = f" {ascii_lower(text or '').translate(_SPACES)} "
        while "  " in text:
            text = text.replace("  ", " ")
        if text == " ":
            return np.zeros(0, np.uint32)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        out, h = [], points
        for n in range(2, max(ORDERS) + 1):
            h = (h[:-1] * _MIX) ^ points[n - 1 :]
            if n in ORDERS and len(h):
                out.append(((h + np.uint64(n)) * _MIX >> np.uint64(64 - BITS)).astype(np.uint32))
        if not out:
            return np.zeros(0, np.uint32)
        bins = np.concatenate(out)
        place = np.arange(len(bins), dtype=np.int32)
        self.stamp[bins] = place
        return bins[self.stamp[bins] == place]


class Counts:
    """How many texts of each label hold each bin."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray):
        self.of = np.zeros((2, 1 << BITS), np.float64)
        for bins, label in zip(rows, y, strict=True):
            self.of[int(label), bins] += 1
        n = np.array([(y == 0).sum(), (y == 1).sum()], float)
        share = (self.of + SMOOTH) / (n[:, None] + 1)
        self.ratio = np.log(share[1]) - np.log(share[0])
        both, p = self.of.sum(0), n[1] / n.sum()
        self.deviations = np.abs(self.of[1] - both * p) / np.sqrt(np.maximum(both * p * (1 - p) * (1 - both / n.sum()), 1e-9))
        self.known = both >= min(LEAST_DOCS, len(y) // 8 + 1)


def solve(rows: list[np.ndarray], y: np.ndarray, counts: Counts, least: float, penalty: float) -> tuple[np.ndarray, float]:
    """Weight of each bin (ratio times coefficient) and the intercept; ``least``: deviations that a feature is kept from."""
    used = counts.known & (counts.deviations >= least)
    weights, index = np.zeros(1 << BITS, np.float32), np.cumsum(used) - 1
    kept = [index[b[used[b]]] for b in rows]
    which = np.repeat(np.arange(len(kept)), [len(b) for b in kept])
    cols = np.concatenate(kept) if len(which) else np.zeros(0, np.int64)
    r = counts.ratio[used]
    value, w, bias = r[cols], np.zeros(len(r)), float(np.log(max((y == 1).sum(), 0.5) / max((y == 0).sum(), 0.5)))
    m1, m2, b1, b2 = np.zeros(len(r)), np.zeros(len(r)), 0.0, 0.0
    for step in range(1, STEPS + 1):  # Adam on the whole sample
        z = bias + np.bincount(which, value * w[cols], len(kept))
        gap = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        g, gb = np.bincount(cols, value * gap[which], len(r)) + penalty * w, gap.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        a, b = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.02 * (m1 / a) / (np.sqrt(m2 / b) + 1e-6)
        bias -= 0.02 * (b1 / a) / (np.sqrt(b2 / b) + 1e-6)
    weights[used] = w * r
    return weights, bias


def losses(rows: list[np.ndarray], y: np.ndarray, folds: np.ndarray) -> list[float]:
    """Logarithmic loss of each choice over the folds, each scored by a fit on the others."""
    out = np.zeros(len(CHOICES))
    for k in range(PARTS):
        own, rest = np.flatnonzero(folds == k), np.flatnonzero(folds != k)
        if not len(own) or len(np.unique(y[rest])) < 2:
            continue
        some = [rows[i] for i in rest]
        counts = Counts(some, y[rest])
        for c, choice in enumerate(CHOICES):
            weights, bias = solve(some, y[rest], counts, *choice)
            z = np.array([bias + weights[rows[i]].sum(dtype=np.float64) for i in own])
            out[c] += np.logaddexp(0, -(2 * y[own] - 1) * z).sum()
    return out.tolist()


def fit(texts, labels) -> tuple[np.ndarray, float]:
    """Weight of each bin and the intercept, under the choice that the folds prefer."""
    features, y = Features(), np.asarray(labels, np.float64)
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(1 << BITS, np.float32), -np.inf
    rows = [features(t) for t in texts]
    folds = np.empty(len(y), np.int64)
    for label in (0, 1):  # as many of each label in every fold, dealt in the order of the rows
        mine = np.flatnonzero(y == label)
        folds[mine] = np.arange(len(mine)) % PARTS
    return solve(rows, y, Counts(rows, y), *CHOICES[int(np.argmin(losses(rows, y, folds)))])


def fold(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % FOLDS


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """At most SAMPLE rows (id, text, label) outside the held-out fold, one for each id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != 0))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    rows = rows.join(F.broadcast(known), F.col("_doc") == F.col("_id"))  # known: SAMPLE rows
    least = F.min(F.struct(F.xxhash64("_text").alias("h"), "_text")).alias("x")  # copies of an id are reduced before they meet
    return rows.groupBy("_id").agg(F.max("_label").alias("_label"), least).select("_id", F.col("x._text").alias("_text"), "_label")


def train(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Fit in one task on an executor; the driver gets one table of 4 MB."""

    def run(batches):
        pdf = pd.concat([*batches, pd.DataFrame({"_id": [], "_text": [], "_label": []})])
        pdf = pdf.sort_values("_id")
        weights, bias = fit(pdf["_text"], pdf["_label"].astype(float))
        yield pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})

    got = rows.repartition(1).mapInPandas(run, "weights binary, bias double").collect()
    if not got:
        return np.zeros(1 << BITS, np.float32), -np.inf
    return np.frombuffer(got[0].weights, np.float32), got[0].bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """(doc, toxicity): each row of ``docs`` as a struct, and its score, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(text: pd.Series) -> pd.Series:
        (weights, bias), features = shared.value, Features()
        z = np.array([bias + float(weights[features(t)].sum(dtype=np.float64)) for t in text])
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -700, 700))) * np.isfinite(z))

    return docs.select(F.struct(*docs.columns).alias("doc"), toxicity(F.col(text_col)).alias("toxicity"))


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = train(sample(docs, labels, "doc_id", "text", "toxic"))
    rows = score(docs, model).select("doc.doc_id", "toxicity")
    rows = rows.select("doc_id", (fold("doc_id") == 0).alias("held_out"), F.col("toxicity").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
