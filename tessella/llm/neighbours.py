"""Approximate nearest neighbours by learned partitions: largest inner products.

The neighbour graph of a sample is cut to balanced parts (bisection along the widest direction, then swaps of pairs that
lower the number of cut edges, parts exactly even), and a small classifier with one hidden layer learns which parts hold the
neighbours of a vector. Every vector goes to its most probable part, a query to several parts, and all rows of these are
reranked by exact inner products in double precision. With over ``PARTS`` parts to make, each part is divided again by a
graph and classifier of its own, and a leaf's probability is the product of both.

The index is fitted on a sample of at most ``SAMPLE`` vectors (and as many of each part on the second level); every
vector is indexed. How many leaves a query visits is measured: ``TRIAL`` vectors are searched in all rows by brute force,
and the least number that finds the share ``RECALL`` of their neighbours is taken. A query visits more where its leaves
hold fewer rows than it asks for, so all candidates are found if they are few.

Equal vectors are searched once and kept with their smallest ids, as many as a query can return, which loses none. A leaf is
cut to blocks of rows and its queries to blocks as well, so no task takes a leaf of any size as a whole.

Vectors that are null, empty or zero, or hold null or non-finite components, take no part, nor do rows without an id or
vectors whose length differs from the commonest one (the smaller of equally common ones). Rows that repeat an id and vector
are one; an id with several vectors asks with each, and never finds its own id. Equal scores go to smaller ids. Other columns
are not read. Empty in, empty out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, discard

SAMPLE, PARTS, TRIAL, RECALL = 16_384, 256, 256, 0.95
#: Neighbours in the graph, nodes of the hidden layer, passes of the training.
DEGREE, HIDDEN, EPOCHS = 10, 128, 20
#: Rows, and queries, that one task compares.
ROWS, ASKS = 8192, 8192


def parts_for(n: int) -> int:
    """Leaves for n vectors: a quarter of the square root."""
    return min(max(1, int(np.ceil(np.sqrt(n) / 4))), PARTS * PARTS)


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def graph(x: np.ndarray, k: int = DEGREE) -> np.ndarray:
    """The k nearest others of each row."""
    k, out = min(k, len(x) - 1), []
    for a in range(0, len(x), 1024):
        near = x[a : a + 1024] @ x.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        out.append(np.argpartition(-near, k - 1, axis=1)[:, :k] if k else np.zeros((len(near), 0), int))
    return np.concatenate(out)


def _bisect(x: np.ndarray, i: np.ndarray, j: np.ndarray, share: float) -> np.ndarray:
    """True for the share of the rows that goes left; edges i, j between them are cut as little as swaps can."""
    n = len(x)
    centred, way = x - x.mean(0), np.ones(x.shape[1], np.float32)
    for _ in range(20):  # towards the widest direction
        way = centred.T @ (centred @ way)
        way /= np.linalg.norm(way) or 1
    left = np.zeros(n, bool)
    left[np.argsort(centred @ way, kind="stable")[: round(n * share)]] = True
    fewest = (left[i] != left[j]).sum()
    for _ in range(30):
        apart = np.where(left[i] != left[j], 1, -1)
        gain = np.bincount(i, apart, n) + np.bincount(j, apart, n)
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        better = int((gain[a[:m]] + gain[b[:m]] > 0).sum())
        moved = left.copy()
        some = max(better // 3, min(better, 1))  # neighbours that change sides together gain nothing
        moved[a[:some]], moved[b[:some]] = False, True
        now = (moved[i] != moved[j]).sum()
        if not some or now >= fewest:
            break
        left, fewest = moved, now
    return left


def balanced(x: np.ndarray, near: np.ndarray, m: int) -> np.ndarray:
    """The part of each row, m parts of even size."""
    part = np.zeros(len(x), int)
    i, j = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
    work = [(np.arange(len(x)), 0, m)]
    while work:
        rows, first, k = work.pop()
        if k == 1 or len(rows) < 2:
            part[rows] = first
            continue
        where = np.full(len(x), -1)
        where[rows] = np.arange(len(rows))
        inside = (where[i] >= 0) & (where[j] >= 0)
        left = _bisect(x[rows], where[i[inside]], where[j[inside]], (k // 2) / k)
        work += [(rows[left], first, k // 2), (rows[~left], first + k // 2, k - k // 2)]
    return part


def fit(x: np.ndarray, m: int) -> list[np.ndarray]:
    """Weights of the classifier that leads a vector to the parts of its neighbours."""
    x = unit(np.asarray(x, float))
    near = graph(x)
    part = balanced(x, near, m)
    goal = np.zeros((len(x), m), np.float32)
    np.add.at(goal, (np.arange(len(x)), part), 1)
    np.add.at(goal, (np.repeat(np.arange(len(x)), near.shape[1]), part[near.ravel()]), 1)
    goal /= goal.sum(1, keepdims=True)
    r = np.random.default_rng(0)
    w = [r.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, m)), np.zeros(m)]
    w = [a.astype(np.float32) for a in w]
    mean, square, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(EPOCHS if m > 1 else 0):
        order = r.permutation(len(x))
        for a in range(0, len(x), 256):
            rows, step = order[a : a + 256], step + 1
            h = np.maximum(x[rows] @ w[0] + w[1], 0)
            e = (softmax(h @ w[2] + w[3]) - goal[rows]) / len(rows)
            back = (e @ w[2].T) * (h > 0)
            for k, g in enumerate((x[rows].T @ back, back.sum(0), h.T @ e, e.sum(0))):
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                w[k] = w[k] - 0.004 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return w


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def probabilities(w: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return softmax(np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3])


class Index:
    """The root's classifier and, with two levels, one for each of its parts; leaves are numbered part by part."""

    def __init__(self, root: list[np.ndarray], below: dict[int, list[np.ndarray]] | None = None, width: int = 1):
        self.root, self.below, self.width = root, below or {}, width
        self.leaves = len(root[3]) * width

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        x = unit(x)
        part = probabilities(self.root, x).argmax(1)
        leaf = part * self.width
        for p in np.unique(part) if self.below else ():
            if p in self.below:
                leaf[part == p] += probabilities(self.below[p], x[part == p]).argmax(1)
        return leaf

    def route(self, x: np.ndarray) -> np.ndarray:
        """Each vector's leaves, most probable first; with two levels, those of the ``ROOTS`` most probable parts come first."""
        x = unit(x)
        first = probabilities(self.root, x)
        if not self.below:
            return np.argsort(-first, axis=1, kind="stable")
        order = np.argsort(-first, axis=1, kind="stable")
        out = np.empty((len(x), self.leaves), np.int32)
        for k, row in enumerate(x):
            some, rest = order[k, :ROOTS], order[k, ROOTS:]
            chance = np.concatenate([first[k, p] * (probabilities(self.below[p], row[None])[0] if p in self.below else np.eye(1, self.width)[0]) for p in some])
            leaves = (some[:, None] * self.width + np.arange(self.width)).ravel()
            out[k] = np.concatenate([leaves[np.argsort(-chance, kind="stable")], (rest[:, None] * self.width + np.arange(self.width)).ravel()])
        return out


#: Parts of the first level whose leaves are ranked by probability.
ROOTS = 16


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    v = F.col("embedding")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = rows.select("vec_id", F.when(fine, F.transform(v, lambda c: c.cast("double"))).alias("vector")).where("vec_id is not null and size(vector) > 0")
    sizes = rows.groupBy(F.size("vector").alias("size")).count()
    best = sizes.orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("vector") == (best.size if best else 0)).distinct()


def learn(vectors: DataFrame, n: int, parts: int | None = None, most: int = PARTS, sample: int = SAMPLE) -> Index:
    """An index of as many leaves as n vectors need, fitted on bounded samples drawn by a hash of the content."""
    leaves = parts or parts_for(n)
    first = min(leaves, most)
    order = [F.xxhash64("vector"), F.col("vector")]
    size = min(sample, max(64 * first, 1024))
    some = vectors.orderBy(*order).limit(size).select("vector").toArrow()
    root = fit(matrix(some["vector"]), first)
    if leaves <= most:
        return Index(root)
    width, top = -(-leaves // first), Index(root)
    window = Window.partitionBy("leaf").orderBy(*order)
    drawn = placed(vectors, top).withColumn("nth", F.row_number().over(window)).where(F.col("nth") <= min(sample, 64 * width))

    def below(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["vector"].to_numpy())
        w = fit(x[np.lexsort(x.T)], width)
        return pd.DataFrame({"leaf": [int(pdf["leaf"].iloc[0])], **{f"w{k}": [a.tobytes()] for k, a in enumerate(w)}})

    made = drawn.groupBy("leaf").applyInPandas(below, "leaf int, w0 binary, w1 binary, w2 binary, w3 binary")  # a row a part, ``most`` at most
    shapes = [(-1, HIDDEN), (HIDDEN,), (HIDDEN, width), (width,)]
    return Index(root, {r.leaf: [np.frombuffer(r[f"w{k}"], np.float32).reshape(s) for k, s in enumerate(shapes)] for r in made.collect()}, width)


def placed(vectors: DataFrame, index: Index) -> DataFrame:
    """Adds ``leaf``."""

    def run(batches):
        for b in batches:
            leaf = index.place(matrix(b.column("vector"))) if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], names=[*b.schema.names, "leaf"])

    return vectors.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in vectors.dtypes) + ", leaf int")


def visits(index_rows: DataFrame, index: Index, trial: np.ndarray, k: int, recall: float = RECALL) -> int:
    """The least number of leaves that finds ``recall`` of the k nearest of the trial vectors, by brute force over all rows."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            near = trial @ matrix(b.column("vector")).T
            top = np.argpartition(-near, min(k, near.shape[1]) - 1, axis=1)[:, :k]
            q = np.repeat(np.arange(len(trial)), top.shape[1])
            leaf = b.column("leaf").to_numpy()[top.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(leaf, pa.int32()), pa.array(near[q, top.ravel()])], names=["q", "leaf", "score"])

    found = index_rows.select("vector", "leaf").mapInArrow(run, "q int, leaf int, score double")
    best = found.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "leaf"))).where(F.col("nth") <= k)
    rows = best.select("q", "leaf").collect()  # k for each trial vector
    if not rows:
        return 1
    q, leaf = np.array([r.q for r in rows]), np.array([r.leaf for r in rows])
    place = np.argsort(index.route(trial), axis=1)  # where each leaf stands in the order of a trial vector
    return int(np.quantile(place[q, leaf], recall, method="higher")) + 1


def nearest(q: np.ndarray, c: np.ndarray, ids: list, k: int):
    """For each row of q: (scores, ids) of the k best of the rows c, each of which stands for a list of ids.

    Products by blocks choose what is summed again, component by component from the first, so that a score does not
    depend on the block; whatever could still be among the k best is summed.
    """
    slack = 1e-12 * c.shape[1] * np.abs(q).max() * np.abs(c).max() if len(c) and len(q) else 0
    for a in range(0, len(q), 512):
        near = q[a : a + 512] @ c.T
        least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -np.inf)
        for row, scores, limit in zip(q[a : a + 512], near, least, strict=True):
            hits = np.flatnonzero(scores >= limit - slack)
            exact = np.cumsum(row * c[hits], axis=1)[:, -1]
            order = np.argsort(-exact, kind="stable")
            if len(order) > k:
                order = order[exact[order] >= exact[order[k - 1]]]
            best = sorted((-exact[o], i) for o in order for i in ids[hits[o]])[:k]
            yield [-s for s, _ in best], [i for _, i in best]


def search(vectors: DataFrame, asked: DataFrame, index: Index, probes: int, k: int) -> DataFrame:
    """(key, score, vec_id): the k best rows of each asked vector (key, vector), among the leaves that it visits.

    ``vectors`` has (vector, ids, leaf). Leaves and their queries are cut to blocks; the two tables of sizes have a row a leaf.
    """
    counts = vectors.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("rows")).toPandas()  # a row a leaf
    rows = np.zeros(index.leaves, np.int64)
    rows[counts["leaf"]] = counts["rows"]
    blocks = np.ones(index.leaves, np.int64)
    blocks[counts["leaf"]] = -(-counts["n"] // ROWS)

    def lead(batches):
        for b in batches:
            if not b.num_rows:
                continue
            order = index.route(matrix(b.column("vector")))
            enough = (np.cumsum(rows[order], axis=1) < k).sum(1) + 1
            take = np.minimum(np.maximum(enough, probes), order.shape[1])
            at = np.repeat(np.arange(len(order)), take)
            leaf = np.concatenate([o[:t] for o, t in zip(order, take, strict=True)])
            full = rows[leaf] > 0
            at, leaf = pa.array(at[full]), pa.array(leaf[full], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("key").take(at), b.column("vector").take(at), leaf], names=["key", "vector", "leaf"])

    led = cut(asked.select("key", "vector").mapInArrow(lead, "key long, vector array<double>, leaf int"), "neighbours-led")
    loads = led.groupBy("leaf").count().toPandas()  # a row a leaf
    teams = np.ones(index.leaves, np.int64)
    teams[loads["leaf"]] = -(-loads["count"] // ASKS)
    spark = vectors.sparkSession
    plan = spark.createDataFrame(pd.DataFrame({"leaf": np.arange(index.leaves, dtype=np.int32), "blocks": blocks, "teams": teams}), "leaf int, blocks long, teams long")
    plan = F.broadcast(plan)  # a row a leaf, 65,536 at most
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = led.join(plan, "leaf").withColumn("team", F.pmod(F.xxhash64("key"), "teams")).withColumn("block", each("blocks"))
    right = vectors.join(plan, "leaf").withColumn("block", F.pmod(F.xxhash64("vector"), "blocks")).withColumn("team", each("teams"))
    keys = ["leaf", "block", "team"]

    def compare(asks: pa.Table, held: pa.Table) -> pa.Table:
        if not asks.num_rows or not held.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "scores": pa.array([], pa.list_(pa.float64())), "ids": pa.array([], pa.list_(pa.int64()))})
        found = list(nearest(matrix(asks["vector"]), matrix(held["vector"]), held["ids"].to_pylist(), k))
        return pa.table({"key": asks["key"], "scores": pa.array([f[0] for f in found], pa.list_(pa.float64())), "ids": pa.array([f[1] for f in found], pa.list_(pa.int64()))})

    pairs = left.select(*keys, "key", "vector").groupBy(*keys).cogroup(right.select(*keys, "vector", "ids").groupBy(*keys))
    lists = pairs.applyInArrow(compare, "key long, scores array<double>, ids array<long>")
    single = lists.select("key", F.explode(F.arrays_zip("scores", "ids")).alias("x")).select("key", F.col("x.scores").alias("score"), F.col("x.ids").alias("vec_id"))
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    return single.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")


def neighbours(rows: DataFrame, queries, k: int = 20, parts: int | None = None, most: int = PARTS, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of (vec_id, embedding) for which the column ``queries`` holds."""
    rows = cut(usable(rows), "neighbours-usable")
    # a query returns k rows and may meet its own id among those of an equal vector
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    groups = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    vectors = cut(groups.withColumn("key", F.monotonically_increasing_id()), "neighbours-vectors")
    n = vectors.count()
    if not n:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    index = learn(vectors, n, parts, most)
    at = cut(placed(vectors, index), "neighbours-placed")
    asks = cut(rows.where(queries).join(vectors, "vector").select(F.col("vec_id").alias("query_id"), "key"), "neighbours-asks")
    asked = vectors.join(asks.select("key").distinct(), "key", "left_semi")
    trial = asked.orderBy(F.xxhash64("vector", F.lit(1)), "vector").limit(TRIAL).select("vector").toArrow()
    probes = visits(at, index, matrix(trial["vector"]), k, recall) if len(trial) else 1
    best = search(at, asked, index, probes, k + 1)
    lists = asks.join(best, "key").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    out = lists.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    done = cut(out, "neighbours-found")
    discard(rows, vectors, at, asks)
    return done


def query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return neighbours(rows, F.col("vec_id") % 20 == 0)
