import numpy as np
import pytest
from helpers import clashing, store
from pyspark.sql import functions as F

from tessella.llm import neighbours

KIND = "vec_id long, embedding array<float>"


def product(v, w):
    total = 0.0
    for a, b in zip(v, w, strict=True):
        total += a * b
    return total


def plain(rows, k=20, every=20):
    """(query_id, rank, vec_id, score) by brute force, each product summed from the first component on."""
    fine = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = []
    for q, v in fine:
        if q % every == 0:
            near = sorted((-product(v, w), i) for i, w in fine if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(near, 1)]
    return sorted(out)


def clusters(n, d=16, groups=8, seed=0):
    r = np.random.default_rng(seed)
    at = r.normal(size=(groups, d))[r.integers(0, groups, n)] + 0.5 * r.normal(size=(n, d))
    return (at * r.uniform(0.5, 2, (n, 1))).astype(np.float32)


def test_parts_are_even_and_cut_few_edges():
    x = neighbours.unit(clusters(640).astype(float))
    near = neighbours.graph(x)
    part = neighbours.balanced(x, near, 8)
    assert sorted(np.bincount(part)) == [80] * 8
    cut = (part[:, None] != part[near]).mean()
    mixed = np.random.default_rng(0).permutation(part)
    assert cut < 0.6 * (mixed[:, None] != mixed[near]).mean()


def test_the_classifier_leads_to_the_parts_of_neighbours():
    x = clusters(1000).astype(float)
    index = neighbours.Index(neighbours.fit(x[:800], 8))
    leaf = index.place(x)
    near = np.argsort(-(x[800:] @ x.T), axis=1)[:, 1:11]
    place = np.argsort(index.route(x[800:]), axis=1)[np.arange(200)[:, None], leaf[near]]
    assert (place < 4).mean() > 0.8  # half of the leaves


@pytest.mark.parametrize("most", [6, 2])  # one level; two
def test_all_neighbours_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(neighbours, "ROWS", 40)
    monkeypatch.setattr(neighbours, "ASKS", 3)  # blocks of both kinds
    rows = list(enumerate(clusters(400).tolist()))
    frame = spark.createDataFrame(rows, KIND).repartition(5)
    got = neighbours.neighbours(frame, F.col("vec_id") % 20 == 0, 20, parts=6, most=most, recall=1.0)
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_hard_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    r = np.random.default_rng(3)
    big = 9007199254740993
    same = [1.0, 0.5, 0.0, 0.0]
    rows = [(k, same) for k in range(100, 200)]  # a vector that many rows share
    rows += [(big, [0.5, 0.5, 0.5, 0.5]), (big + 1, [0.5, 0.5, 0.5, 0.5]), (40, [0.0] * 4), (60, None), (80, [1.0, None, 0.0, 0.0]), (220, [1.0, nan, 0.0, 0.0]), (240, [inf, 0.0, 0.0, 0.0]), (260, []), (280, [1.0, 2.0]), (None, [9.0] * 4)]
    rows += [(k, r.integers(-2, 3, 4).astype(float).tolist()) for k in range(300, 400)]  # many ties
    frame = spark.createDataFrame(rows + rows[:3], KIND)
    sf = store(spark, tmp_path, "embeddings", clashing(frame, "key", "vector", "leaf", "score", "rank"))
    got = sorted(map(tuple, neighbours.query(spark, sf).collect()))
    assert got == plain([r for r in rows if r[0] != 280])  # 280 has another length


@pytest.mark.parametrize("n", [0, 1, 2, 15])
def test_few_rows_find_all_others(spark, n):
    rows = [(20 * k, v) for k, v in enumerate(clusters(n).tolist())]
    got = neighbours.neighbours(spark.createDataFrame(rows, KIND), F.col("vec_id") % 20 == 0, parts=3)
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_numpy()).astype(float)
    asks = np.flatnonzero(ids % 20 == 0)
    got = neighbours.query(spark, sf).toPandas()
    assert len(got) == 20 * len(asks) and not got.duplicated(["query_id", "vec_id"]).any() and (got.query_id != got.vec_id).all()
    found = 0
    for q in asks:
        near = x @ x[q]
        near[q] = -np.inf
        found += len(set(ids[np.argsort(-near)[:20]]) & set(got.vec_id[got.query_id == ids[q]]))
    assert found >= 0.9 * len(got)
