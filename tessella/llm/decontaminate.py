"""Benchmark decontamination by SimHash over item-sized windows.

For every item size all windows of that many words (the whole text, where it is shorter) get a SimHash of their
five-word shingles, from running sums of the hashes' bits. Fingerprints are cut into eight bytes: a fingerprint within
``RADIUS`` bits of an item's has a byte within RADIUS // 8 bits of the item's, so a table of items for each byte value
finds all of them. Candidates within the radius are verified by the weighted Jaccard similarity of the shingles, each
weighing as often as it occurs; a window leaks an item from ``SIMILAR`` on. At similarity 0.8 the fingerprints of
equally long texts differ by 10 bits on average; 19 is over three standard deviations more.

Windows are those of the whole text: an item's size of words, or all the text's words where they are fewer. They are
worked through in stretches of ``STRETCH`` first words, so the result does not depend on where a stretch ends. A window
is passed over if less than ``SIMILAR`` of its shingles are shingles of any item, as then it can't be similar enough to
one. Benchmarks up to ``BLOCK`` characters take one pass; a larger one is worked through in blocks, each broadcast,
applied, written and released before the next.

Nulls: a null text or item is an empty one; an empty item leaks nowhere; items of under five words count as one
shingle. Null ids are carried, and ids of any kind stay exact. Repeated rows give repeated results. An empty table gives
an empty result. Columns of any other name are kept or ignored as they are, so none can clash.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm.common import WORD, ascii_lower, cut
from tessella.llm.simhash import shingle_hashes

SHINGLE, SIMILAR, RADIUS, STRETCH, BLOCK = 5, 0.8, 19, 1 << 14, 16_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _prints(ones: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of rows that say how often each bit is set in n hashes."""
    return np.packbits(ones * 2 > n, axis=1).view(">u8").ravel().astype(np.uint64)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags."""
    shared = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared)


class Index:
    """Items by size, their fingerprints and the byte tables."""

    def __init__(self, items: list[tuple]):
        self.ids, self.bags, self.vocab, self.gates, sizes = [], [], {}, {}, {}
        for item_id, text in items:
            words = WORD.findall(ascii_lower(text or ""))
            if not words:
                continue
            n = min(SHINGLE, len(words))
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.uint64)
            self.gates.setdefault(n, set()).update(self._runs(ids, n)[1].tolist())
            hashes = shingle_hashes(words, SHINGLE)
            self.bags.append(Counter(hashes.tolist()))
            sizes.setdefault(len(words), []).append((len(self.ids), int(_prints(_bits(hashes).sum(0, dtype=np.int64)[None], len(hashes))[0])))
            self.ids.append(item_id)
        self.gates = {n: np.array(sorted(x), np.uint64) for n, x in self.gates.items()}
        self.sizes = {size: self._tables(rows) for size, rows in sorted(sizes.items())}
        self.largest = max(self.sizes, default=0)

    @staticmethod
    def _tables(rows):
        items, prints = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.uint64)
        parts = prints.astype(">u8").view(np.uint8).reshape(-1, 8)
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None, None] ^ parts[None]) <= RADIUS // 8  # value, item, byte
        return items, prints, np.packbits(near.transpose(2, 0, 1), axis=2)

    @staticmethod
    def _runs(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of n known words in a row and a hash of each."""
        known = ids > 0
        run, h = np.ones(max(0, len(ids) - n + 1), bool), np.zeros(max(0, len(ids) - n + 1), np.uint64)
        for k in range(n):
            run &= known[k : len(run) + k]
        at = np.flatnonzero(run)
        h = h[at]
        for k in range(n):
            h = (h ^ ids[at + k]) * _MIX
            h ^= h >> np.uint64(29)
        return at, h

    def hits(self, words: list[str]) -> dict[int, np.ndarray]:
        """By shingle length, how many of the first i shingles are an item's; without lengths that have none."""
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), np.uint64, len(words))
        out = {}
        for n, gate in self.gates.items():
            at, h = self._runs(ids, n)
            at = at[gate[np.minimum(np.searchsorted(gate, h), len(gate) - 1)] == h]
            if len(at):
                hit = np.zeros(max(1, len(words) - n + 1) + 1, np.int32)
                hit[at + 1] = 1
                out[n] = np.cumsum(hit)
        return out

    def find(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the most similar window of each item that the text leaks."""
        words = WORD.findall(ascii_lower(text or ""))
        best: dict[int, tuple] = {}
        if not words or not self.sizes:
            return []
        for at in range(0, len(words), STRETCH):
            part = words[at : at + STRETCH + self.largest - 1]
            if hits := self.hits(part):
                self._windows(part, hits, at, len(words), best)
        return [(k, *best[k]) for k in sorted(best)]

    def _windows(self, words: list[str], hits: dict, offset: int, total: int, best: dict) -> None:
        """The windows that begin in a stretch: its first STRETCH words, of which ``offset`` are before; ``words`` go on behind it."""
        sums = {}
        for size, (items, prints, tables) in self.sizes.items():
            size = min(size, total)
            n = min(SHINGLE, size)
            k = size - n + 1
            if n not in hits or size > len(words):
                continue
            places = np.flatnonzero(hits[n][k:] - hits[n][:-k] >= SIMILAR * k - 1e-9)  # no other window can leak
            places = places[places < STRETCH]
            if not len(places):
                continue
            if n not in sums:
                hashes = shingle_hashes(words, n)
                sums[n] = hashes, np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_bits(hashes), axis=0, dtype=np.int32)])
            hashes, running = sums[n]
            found = _prints(running[places + k] - running[places], k)
            parts = found.astype(">u8").view(np.uint8).reshape(-1, 8)
            near = tables[0][parts[:, 0]]
            for b in range(1, 8):
                near = near | tables[b][parts[:, b]]
            window, item = np.nonzero(np.unpackbits(near, axis=1, count=len(items)))
            close = np.bitwise_count(found[window] ^ prints[item]) <= RADIUS
            for w, i in zip(places[window[close]].tolist(), items[item[close]].tolist(), strict=True):
                s = similarity(Counter(hashes[w : w + k].tolist()), self.bags[i])
                if s >= SIMILAR and s > best.get(i, (0,))[0]:
                    best[i] = s, offset + w, size


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """Indexes of the benchmark's items, each over about BLOCK characters of it."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = total // BLOCK + 1
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else rows
        items = sorted(((r.id, r.text) for r in part.collect()), key=str)
        if items:
            yield Index(items)


def _passes(benchmark: DataFrame, item_col: str, apply) -> DataFrame:
    """``apply(index, last)`` for each block's broadcast index in turn; all but the last one's result is written first."""
    spark, out, before = benchmark.sparkSession, None, None
    for index in blocks(benchmark, item_col):
        if before is not None:
            out = cut(apply(before, out), "decontaminate")
            before.destroy()
        before = spark.sparkContext.broadcast(index)
    return out if before is None else apply(before, out)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, item, similarity, first word, words): every document and item it leaks, at the most similar window."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    kinds = dict(rows.dtypes)["doc"], dict(benchmark.dtypes)[item_col]
    schema = f"doc {kinds[0]}, item {kinds[1]}, similarity double, first_word long, n_words long"
    kind = to_arrow_type(benchmark.schema[item_col].dataType)

    def apply(shared, before):
        def run(batches):  # Arrow batches: ids never pass through pandas
            for b in batches:
                found = [(k, *hit) for k, text in enumerate(b.column("text").to_pylist()) for hit in shared.value.find(text)]
                if found:
                    at, item, similar, word, n = zip(*found, strict=True)
                    ids = pa.array([shared.value.ids[i] for i in item], kind)
                    yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(at)), ids, pa.array(similar), pa.array(word), pa.array(n)], names=["doc", "item", "similarity", "first_word", "n_words"])

        new = rows.mapInArrow(run, schema)
        return new if before is None else before.unionByName(new)

    out = _passes(benchmark, item_col, apply)
    out = docs.sparkSession.createDataFrame([], schema) if out is None else out
    return out.withColumnsRenamed({"doc": id_col, "item": item_col})


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The documents that leak no item, with all their columns."""

    def apply(shared, before):
        @F.pandas_udf("boolean")
        def leaky(text: pd.Series) -> pd.Series:
            return pd.Series([bool(shared.value.find(t)) for t in text], dtype=bool)

        rows = docs if before is None else before
        return rows.where(~leaky(F.col(text_col)))

    out = _passes(benchmark, item_col, apply)
    return docs if out is None else out


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark, docs, sf_dir):
    """Documents that leak no benchmark item."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
