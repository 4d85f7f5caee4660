import random
import zlib

import numpy as np
from helpers import clashing, docs, store

from tessella.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def planted(n, seed=3):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 6))) for _ in range(300)]
    rows, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        text = r.choices(words, k=r.randint(5, 200)) + (r.choices(["zqidiot", "zqscum", "zqtrash"], k=2) if bad else [])
        r.shuffle(text)
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark, tmp_path):
    rows, labels = planted(600)
    sf = store(spark, tmp_path, "documents", docs(spark, rows))
    store(spark, tmp_path, "labels", spark.createDataFrame(labels, LABELS))
    got = toxicity.query(spark, sf).collect()
    assert {r.doc_id: r.held_out for r in got} == {k: zlib.crc32(str(k).encode()) % 5 == 0 for k, _ in rows}
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.97
    assert got == toxicity.query(spark, sf).collect() or sorted(got) == sorted(toxicity.query(spark, sf).collect())


def test_held_out_labels_of_a_real_table(spark):
    """Found: at least 0.8 of the held-out toxic rows, where 0.17 of all toxic rows hold no toxic word; false alarms: at most 1 in 100."""
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [r for r in toxicity.query(spark, d).collect() if r.held_out and r.doc_id in labels]
    assert sum(labels[r.doc_id] for r in held) > 80
    assert np.mean([r.predicted for r in held if labels[r.doc_id]]) >= 0.8
    assert np.mean([r.predicted for r in held if not labels[r.doc_id]]) <= 0.01


def grams(text):
    """The n-grams of a text by definition."""
    text = " " + " ".join(text.lower().split()) + " "
    return {text[k : k + n] for n in toxicity.ORDERS for k in range(len(text) - n + 1)} if text.strip() else set()


def test_against_a_plain_version():
    """Features, ratios, deviations and the fitted scores, on n-grams as strings."""
    rows, labels = planted(160)
    texts, y = [t for _, t in rows], np.array([x[2] for x in labels], float)
    features = toxicity.Features()
    bins, sets = [features(t) for t in texts], [grams(t) for t in texts]
    assert all(0 <= len(s) - len(b) < 8 for b, s in zip(bins, sets, strict=True))  # a few n-grams share a bin
    every = sorted(set().union(*sets))
    holds = np.array([[g in s for g in every] for s in sets])
    n, by = np.array([(y == 0).sum(), (y == 1).sum()]), np.array([holds[y == 0].sum(0), holds[y == 1].sum(0)])
    ratio = np.log((by[1] + 0.5) / (n[1] + 1)) - np.log((by[0] + 0.5) / (n[0] + 1))
    both, p = by.sum(0), n[1] / n.sum()
    z = np.abs(by[1] - both * p) / np.sqrt(np.maximum(both * p * (1 - p) * (1 - both / n.sum()), 1e-9))
    counts = toxicity.Counts(bins, y)
    held = counts.of.sum(0) > 0
    assert held.sum() > 0.99 * len(every)
    for plain, mine in ((ratio, counts.ratio[held]), (np.minimum(z, 1e3), np.minimum(counts.deviations[held], 1e3))):
        k = np.linspace(0, 1, 200)
        assert np.abs(np.quantile(plain, k) - np.quantile(mine, k)).mean() < 0.01
    # gradient descent on the strings, with the same features and penalty, ends at the same scores
    used = (both >= toxicity.LEAST_DOCS) & (z >= 4)
    x, w, bias = holds[:, used] * ratio[used], np.zeros(used.sum()), np.log(n[1] / n[0])
    for _ in range(4000):
        gap = (1 / (1 + np.exp(-(x @ w + bias))) - y) / len(y)
        w, bias = w - 0.02 * (x.T @ gap + 1e-3 * w), bias - 0.02 * gap.sum()
    weights, b = toxicity.solve(bins, y, counts, 4.0, 1e-3)
    assert (weights != 0).sum() <= used.sum() + 5
    mine = np.array([b + weights[row].sum(dtype=np.float64) for row in bins])
    assert np.corrcoef(mine, x @ w + bias)[0, 1] > 0.98 and ((mine >= 0) == (x @ w + bias >= 0)).mean() > 0.97


def test_a_repeated_id_is_learnt_from_once(spark):
    rows = [(k, f"text number {k} of it") for k in range(40)] + [(3, f"copy {k}") for k in range(500)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(40)], LABELS)
    some = toxicity.sample(docs(spark, rows), labels, "doc_id", "text", "toxic").collect()
    assert len(some) == len({r._id for r in some}) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(40))


def test_distinct_bins():
    f = toxicity.Features()
    assert len(f("")) == len(f(None)) == len(f(" \n ")) == 0
    assert set(f("ab ab")) == set(f("AB\t\nab ")) and len(set(f("ab ab"))) == len(f("ab ab"))
    assert len(f("é😀")) > 0 and len(f("x" * 100000)) == 9


def test_edges(spark, tmp_path):
    sf = store(spark, tmp_path, "documents", docs(spark, [(None, "a b"), (1, None), (1, ""), (2, "w " * 50000), (2, "w " * 50000)]))
    store(spark, tmp_path, "labels", spark.createDataFrame([(1, 1, None), (None, 0, 1), (9, 1, 1)], LABELS))
    rows = toxicity.query(spark, sf).collect()
    assert len(rows) == 5 and all(r.score == 0 and r.predicted == 0 for r in rows)
    own = clashing(docs(spark, [(1, "a b")]), "toxicity", "_text", "_id", "doc")
    assert [r.doc.toxicity for r in toxicity.score(own, (np.zeros(1 << toxicity.BITS, np.float32), 0.0)).collect()] == ["own"]
    assert toxicity.sample(own, spark.createDataFrame([(1, 1, 1)], LABELS), "doc_id", "text", "toxic").count() == 1
    store(spark, tmp_path, "documents", docs(spark, []))
    store(spark, tmp_path, "labels", spark.createDataFrame([], LABELS))
    assert toxicity.query(spark, sf).count() == 0
