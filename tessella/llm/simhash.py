"""SimHash near-duplicates by binary trie self-joins.

A fingerprint's bit is 1 if it is set in over half of the XXH64 hashes of the text's word shingles. Distinct
fingerprints at most ``RADIUS`` bits apart are linked and documents of connected fingerprints form a component.

The 64 bits are cut into RADIUS + 1 blocks: two fingerprints within the radius agree in one of them at least, so each
is dealt to one group a block, by the block's value. In a group the fingerprints form a binary trie, which is joined
with itself: node pairs are walked down together, a cross pair costs one differing bit, and a pair is dropped once it
has used up the radius. A group over ``GROUP`` fingerprints is dealt again by blocks of its other bits, up to four
times, so that a group can't hold more than 2^21 of them. Only links of a spanning forest leave a group.

Nulls: a null text is an empty one; a text without words has fingerprint zero and links like any other. Null ids are
kept, and a component's id is the least id that isn't null. Repeated rows share a component. Empty in, empty out.
Columns of any other name are carried inside one struct, so none can clash.

``near_clusters``, which the pipeline's stage uses, links texts by their sets of five-word shingles at a Jaccard
similarity of 0.8 or more, exactly. Candidates come from the fingerprints' trie self-join, and from a prefix filter that
loses no pair at 0.8; a pair is passed over only where sizes or parities rule out 0.8, and links by the exact count.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WORD, ascii_lower, cut, discard
from tessella.operators.components import stars

SHINGLE, SEED, RADIUS, GROUP = 3, 42, 3, 100_000
CHUNK = 1 << 18


def shingle_hashes(words: list[str], n: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of n words, space-joined; of the whole where there are fewer."""
    parts = [w.encode("utf-8", "surrogatepass") for w in words]
    whole = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    k = max(1, len(parts) - n + 1)
    starts = np.concatenate([[0], ends[: k - 1] + 1]).tolist()
    stops = ends[len(parts) - k :].tolist()
    return np.array([xxhash.xxh64_intdigest(whole[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = WORD.findall(ascii_lower(text or ""))
    if not words:
        return 0
    return _print_of(shingle_hashes(words))


def _print_of(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def trie_links(group: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of pairs within the radius that make a spanning forest of each group's links.

    ``prints`` (uint64) ascend inside each group (ascending). A trie node is a range of the sorted fingerprints that
    share a prefix. Pairs of nodes are walked level by level in chunks, deepest first, so the work list stays bounded.
    """
    n = len(prints)
    label, found = np.arange(n), [np.zeros((2, 0), np.int64)]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    last = np.r_[first[1:], n]
    many = last - first > 1
    if not many.any():
        return found[0][0], found[0][1]
    zeros: dict[int, np.ndarray] = {}  # by level: how many of the first i fingerprints have bit 0 there
    roots = (first[many], last[many], first[many], last[many], np.zeros(many.sum(), np.int8))
    stack = [(63, tuple(x[at : at + CHUNK] for x in roots)) for at in range(0, len(roots[0]), CHUNK)]
    while stack:
        bit, (a, a2, b, b2, cost) = stack.pop()
        alone = (a2 - a == 1) & (b2 - b == 1)
        if alone.any():
            i, j = a[alone], b[alone]
            near = (label[i] != label[j]) & (np.bitwise_count(prints[i] ^ prints[j]) <= radius)
            found.append(_merge(label, i[near], j[near]))
            a, a2, b, b2, cost = (x[~alone] for x in (a, a2, b, b2, cost))
        if bit < 0 and len(a):  # no bit tells these apart, so all are within the radius: each is linked with the first
            for x, x2, y, y2 in zip(a.tolist(), a2.tolist(), b.tolist(), b2.tolist(), strict=True):
                i = np.r_[np.arange(x, x2), np.arange(y, y2)]
                found.append(_merge(label, i, np.full(len(i), x)))
        if not len(a) or bit < 0:
            continue
        if bit not in zeros:
            zeros[bit] = np.r_[0, np.cumsum((prints >> np.uint64(bit)) & np.uint64(1) == 0)]
        z = zeros[bit]
        am, bm = a + z[a2] - z[a], b + z[b2] - z[b]
        self_ = a == b
        pairs = [(a, am, b, bm, cost), (am, a2, bm, b2, cost), (a, am, bm, b2, cost + 1), tuple(x[~self_] for x in (am, a2, b, bm, cost + 1))]
        both = [np.concatenate(x) for x in zip(*pairs, strict=True)]
        good = (both[1] > both[0]) & (both[3] > both[2]) & (both[4] <= radius)
        good &= (both[0] != both[2]) | (both[1] - both[0] > 1)
        both = [x[good] for x in both]
        stack += [(bit - 1, tuple(x[at : at + CHUNK] for x in both)) for at in range(0, len(both[0]), CHUNK)]
    i, j = np.concatenate(found, axis=1)
    return i, j


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the sets of each i and j; labels are the least index of a set. Returns the pairs (2, n) that joined two sets."""
    used = [np.zeros((2, 0), np.int64)]
    while len(i):
        x, y = label[i], label[j]
        apart = x != y
        if not apart.any():
            break
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        top, pick = np.unique(np.maximum(x, y), return_index=True)  # each set joins one other at a time
        label[top] = np.minimum(x, y)[pick]
        used.append(np.stack([i[pick], j[pick]]))
        while True:
            above = label[label]
            if (above == label).all():
                break
            label[:] = above
    return np.concatenate(used, axis=1)


def _blocks(used: int, radius: int = RADIUS) -> list[int]:
    """The bits that ``used`` leaves, in radius + 1 masks, each joined to ``used``."""
    free = [1 << k for k in range(64) if not used >> k & 1]
    cuts = [len(free) * k // (radius + 1) for k in range(radius + 2)]
    return [used | sum(free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(prints: DataFrame, radius: int = RADIUS, most: int = GROUP) -> DataFrame:
    """(u, v) pairs within the radius, by ``node``, that span each group's links; ``prints`` (node, fp).

    Groups are dealt by blocks, which lose no pair.
    """
    masks = _blocks(0, radius)
    value = F.col("fp").bitwiseAND(F.col("used"))
    rows = prints.select("node", "fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("used"))
    ready = None
    for level in range(4):  # groups that are too large are dealt again, by bits that are still free
        large = cut(rows.groupBy("used", value.alias("value")).count().where(F.col("count") > most).drop("count"), "simhash-large")
        if level == 3 or large.isEmpty():
            ready = rows if ready is None else ready.unionByName(rows)
            break
        large = large.withColumn("dealt", F.lit(True))
        rows = rows.withColumn("value", value).join(large, ["used", "value"], "left")
        calm = rows.where("dealt is null").select("node", "fp", "used")
        ready = calm if ready is None else ready.unionByName(calm)
        finer = F.create_map(*(x for m in masks for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(f)) for f in _blocks(m, radius))))))
        rows = rows.where("dealt").select("node", "fp", F.explode(finer[F.col("used")]).alias("used")).distinct()
        masks = list(dict.fromkeys(f for m in masks for f in _blocks(m, radius)))

    def join(batches):
        rest = None

        def solve(fp, used, node):
            value = fp & used
            order = np.lexsort((node, fp, value, used))
            fp, value, used, node = (x[order] for x in (fp, value, used, node))
            group = np.cumsum(np.r_[0, (value[1:] != value[:-1]) | (used[1:] != used[:-1])])
            i, j = trie_links(group, fp, radius)
            return pd.DataFrame({"u": node[i], "v": node[j]})

        for pdf in batches:
            fp, used = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("fp", "used"))
            now = fp, used, pdf["node"].to_numpy(np.int64)
            now = now if rest is None else tuple(map(np.concatenate, zip(rest, now, strict=True)))
            fp, used = now[:2]
            value = fp & used
            differs = np.flatnonzero((value[1:] != value[:-1]) | (used[1:] != used[:-1]))
            whole = differs[-1] + 1 if len(differs) else 0  # the last group may go on in the next batch
            if whole >= CHUNK // 4:
                yield solve(*(x[:whole] for x in now))
                now = tuple(x[whole:] for x in now)
            rest = now
        if rest is not None and len(rest[0]):
            yield solve(*rest)

    dealt = ready.repartition("used", value).sortWithinPartitions("used", value)
    return dealt.mapInPandas(join, "u long, v long")


def _connected(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root, component_id ...) of every node of ``distinct`` (node, least ...); a root names a component."""
    to = stars(edges)
    named = distinct.join(to.withColumnsRenamed({"u": "node", "v": "root"}), "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(named.drop("least").join(ids, "root"), "simhash-named")
    discard(to)
    return named


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, most: int = GROUP) -> DataFrame:
    """(id, fp, component_id) of every document, linked by fingerprints."""

    @F.pandas_udf("long")
    def prints_of(text: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in text], dtype="int64")

    rows = cut(docs.select(F.col(id_col).alias("id"), prints_of(F.col(text_col)).alias("node")), "simhash-prints")
    distinct = cut(rows.groupBy("node").agg(F.min("id").alias("least")), "simhash-distinct")
    named = _connected(distinct, links(distinct.select("node", F.col("node").alias("fp")), radius, most))
    discard(distinct)
    return rows.join(named, "node").select(F.col("id").alias(id_col), F.col("node").alias("fp"), "component_id")


# -- by similarity of shingles ----------------------------------------------------------------------------------------

#: Texts of one hash that one task looks through; beyond, they are dealt to several.
SALT = 1 << 20
#: Shingle length; bits of a text's parities (a power of two, about the size of its set) and of the hashes' buckets.
NEAR_SHINGLE, LEAST_BITS, MOST_BITS, BUCKET_BITS = 5, 64, 1 << 16, 20


def shingle_set(text: str | None) -> np.ndarray:
    """Ascending hashes of the text's runs of five words; of a text without words, zero alone."""
    words = WORD.findall(ascii_lower(text or ""))
    return np.unique(shingle_hashes(words, NEAR_SHINGLE)) if words else np.zeros(1, np.uint64)


def _node(hashes: np.ndarray, seed: int = SEED) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), seed) - (1 << 63)


def _parity(hashes: np.ndarray) -> bytes:
    """Of each bin, whether an odd number of hashes falls into it: two sets differ in as many hashes as bins at least."""
    bins = min(MOST_BITS, max(LEAST_BITS, 1 << (len(hashes) - 1).bit_length()))
    return np.packbits(np.bincount((hashes & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1).tobytes()


def _fold(bits: bytes, size: int) -> int:
    """Parities in as many bins as ``size`` bytes have: bins that agree in their low bits are joined."""
    x = int.from_bytes(bits)
    while len(bits) > size:
        half = len(bits) // 2
        x = (x >> 8 * half) ^ (x & (1 << 8 * half) - 1)
        bits = bits[:half]
    return x


def _possible(n: int, bits: bytes, m: int, other: bytes) -> bool:
    """Whether sets of n and m hashes may be similar by 0.8, going by sizes and parities."""
    if 5 * min(n, m) < 4 * max(n, m):
        return False
    size = min(len(bits), len(other))
    return 9 * (_fold(bits, size) ^ _fold(other, size)).bit_count() <= n + m


def _prefix(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The hashes that come first in the order by ``counts``, then by hash; two sets similar by 0.8 share one of them."""
    k = len(hashes) - (4 * len(hashes) + 4) // 5 + 1
    return hashes[np.argsort(counts[hashes >> np.uint64(64 - BUCKET_BITS)], kind="stable")[:k]]


def _groups(batches, columns: list[str], by: list[str]):
    """Frames of whole groups; rows come with equal ``by`` together."""
    rest = None
    for pdf in batches:
        now = pdf[columns] if rest is None else pd.concat([rest, pdf[columns]], ignore_index=True)
        key = now[by].to_numpy()
        differs = np.flatnonzero((key[1:] != key[:-1]).any(1))
        whole = differs[-1] + 1 if len(differs) else 0
        if whole:
            yield now[:whole]
        rest = now[whole:]
    if rest is not None and len(rest):
        yield rest


def _bucket_counts(rows: DataFrame) -> np.ndarray:
    """Of each bucket of hashes, how often texts have one of it: a table of fixed size, which only orders the hashes."""
    width = (1 << BUCKET_BITS) // 64

    def add(batches):
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for pdf in batches:
            for x in pdf["counts"]:
                total += np.frombuffer(zlib.decompress(x), np.uint32)
        if total.any():
            yield pd.DataFrame({"block": np.arange(64), "counts": [x.tobytes() for x in total.reshape(64, width)]})

    def join(pdf):
        total = sum(np.frombuffer(x, np.int64) for x in pdf["counts"])
        return pd.DataFrame({"block": pdf["block"][:1], "counts": [total.tobytes()]})

    parts = rows.where("counts is not null").select("counts").mapInPandas(add, "block long, counts binary")
    out = np.zeros((64, width), np.int64)
    for r in parts.groupBy("block").applyInPandas(join, "block long, counts binary").collect():
        out[r.block] = np.frombuffer(r.counts, np.int64)
    return out.ravel()


def _shared(docs: DataFrame, text_col: str, counts: np.ndarray) -> DataFrame:
    """(token, salt, node, n, first, first_n): the prefix hashes that several texts have; first is a text of the same group.

    A hash that is counted more than SALT times is dealt to several tasks, by its texts; each then has a first of its own.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(counts)

    def prefixes(batches):
        seen = set()  # of this task's rows: copies of a text count once
        for pdf in batches:
            token, node, n = [np.zeros(0, np.uint64)], [], []
            for text in pdf["text"]:
                h = shingle_set(text)
                if (x := _node(h)) not in seen:
                    seen.add(x)
                    token.append(_prefix(h, ranks.value))
                    node.append(x)
                    n.append(len(h))
            lengths, token = [len(x) for x in token[1:]], np.concatenate(token)
            node = np.repeat(np.array(node, np.int64), lengths)
            parts = ranks.value[token >> np.uint64(64 - BUCKET_BITS)] // SALT
            salt = np.where(parts > 0, node % (parts + 1), -1)
            yield pd.DataFrame({"token": token.view(np.int64), "salt": salt.astype(np.int32), "node": node, "n": np.repeat(np.array(n, np.int32), lengths)})

    def several(batches):
        """In order of token, salt and node; holds one batch and the first of the group that goes on."""
        held = None  # (token, salt, first, first_n, last node, whether the first is out)
        for pdf in batches:
            token, salt, node, n = (pdf[c].to_numpy() for c in ("token", "salt", "node", "n"))
            same = np.r_[held is not None and held[:2] == (token[0], salt[0]) if len(token) else False, (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])]
            again = same & (node == np.r_[held[4] if held else 0, node[:-1]][: len(node)])
            token, salt, node, n, same = (x[~again] for x in (token, salt, node, n, same))
            if not len(token):
                continue
            start = np.flatnonzero(~same)
            run = np.cumsum(~same) - (0 if same[0] else 1)  # run 0 may go on from the batch before
            if same[0]:
                start = np.r_[0, start]
            size = np.diff(np.r_[start, len(token)])
            first, first_n = node[start].copy(), n[start].copy()
            if same[0]:
                first[0], first_n[0] = held[2], held[3]
            goes = size[run] > 1
            if same[0]:
                goes |= run == 0
                if not held[5]:
                    yield pd.DataFrame({"token": [held[0]], "salt": [held[1]], "node": [held[2]], "n": [held[3]], "first": [held[2]], "first_n": [held[3]]})
            elif held and not held[5] and held[1] >= 0:
                yield pd.DataFrame({"token": [held[0]], "salt": [held[1]], "node": [held[2]], "n": [held[3]], "first": [held[2]], "first_n": [held[3]]})
            goes |= (salt >= 0) & (run < run[-1])
            yield pd.DataFrame({"token": token, "salt": salt, "node": node, "n": n, "first": first[run], "first_n": first_n[run]})[goes]
            held = token[-1], salt[-1], first[-1], first_n[-1], node[-1], bool(goes[-1])
        if held and not held[5] and held[1] >= 0:
            yield pd.DataFrame({"token": [held[0]], "salt": [held[1]], "node": [held[2]], "n": [held[3]], "first": [held[2]], "first_n": [held[3]]})

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(prefixes, "token long, salt int, node long, n int")
    rows = rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "node")
    return cut(rows.mapInPandas(several, "token long, salt int, node long, n int, first long, first_n int"), "near-shared")


def _verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The (u, v) whose shingle sets are similar by 0.8 or more, counted exactly, from a text of each node."""

    @F.pandas_udf("binary")
    def sets_of(text: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t).tobytes() for t in text], dtype=object)

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(5 * both >= 4 * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    keys = cut(rows.join(nodes, "node").groupBy("node").agg(F.min(F.struct("id", "th")).alias("k")).select("node", F.col("k.id").alias("k"), F.col("k.th").alias("h")), "near-keys")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    texts = texts.join(keys, F.col("id").eqNullSafe(F.col("k")) & (F.col("th") == F.col("h"))).select("node", sets_of("text").alias("set"))
    sets = cut(texts.dropDuplicates(["node"]), "near-sets")
    both = pairs.join(sets.withColumnsRenamed({"node": "u", "set": "a"}), "u").join(sets.withColumnsRenamed({"node": "v", "set": "b"}), "v")
    found = cut(both.where(similar("a", "b")).select("u", "v"), "near-found")
    discard(keys, sets)
    return found


def _star(shared: DataFrame, distinct: DataFrame) -> DataFrame:
    """Candidates (u, v): pairs of the fingerprints' trie self-join, and each text with the first of its prefix groups."""
    hubs = distinct.groupBy("fp").agg(F.min("node").alias("hub"))
    alike = distinct.join(hubs, "fp").where("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v"))
    close = links(hubs.select(F.col("hub").alias("node"), "fp"))
    first = shared.where("node <> first and 5 * least(n, first_n) >= 4 * greatest(n, first_n)").select(F.col("first").alias("u"), F.col("node").alias("v"))
    pairs = alike.unionByName(close).unionByName(first).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()

    @F.pandas_udf("boolean")
    def possible(n: pd.Series, bits: pd.Series, m: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([_possible(*x) for x in zip(n.tolist(), bits, m.tolist(), other, strict=True)], dtype=bool)

    shapes = distinct.select("node", "n", "bits")
    both = pairs.join(shapes.toDF("u", "n", "bits"), "u").join(shapes.toDF("v", "m", "other"), "v")
    return cut(both.where(possible("n", "bits", "m", "other")).select("u", "v"), "near-pairs")


def _nearest(c, n, root, bits, cross: bool, nearest: bool) -> tuple[list, list]:
    """Places (i, j) of pairs of a small group that may be similar and lie in different components and, if ``cross``, chunks."""
    size, seen, us, vs = [len(x) for x in bits], {}, [], []

    def fold(i, to):
        if (i, to) not in seen:
            seen[i, to] = _fold(bits[i], to)
        return seen[i, to]

    best: dict[int, tuple] = {}
    for i in range(len(n)):
        for j in range(i + 1, len(n)):
            if 4 * n[j] > 5 * n[i]:  # by size, ascending
                break
            if root[i] == root[j] or cross and c[i] == c[j]:
                continue
            to = min(size[i], size[j])
            far = (fold(i, to) ^ fold(j, to)).bit_count()
            if 9 * far > n[i] + n[j]:
                continue
            if nearest:
                for a, b in ((i, j), (j, i)):
                    if a not in best or far < best[a][0]:
                        best[a] = far, b
            else:
                us.append(i)
                vs.append(j)
    return (list(best), [b for _, b in best.values()]) if nearest else (us, vs)


def _nearest_of_many(c, n, root, bits, cross: bool, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """The same for a large group, on arrays: texts of one size of parities against those of that size and the next."""
    size = np.array([len(x) for x in bits])
    best, best_at = np.full(len(n), 1 << 30), np.zeros(len(n), np.int64)
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for to in np.unique(size).tolist():
        begin, end = np.searchsorted(size, [to, to + 1])
        last = int(np.searchsorted(n, n[end - 1] * 5 // 4, "right"))
        w = np.frombuffer(b"".join(_fold(b, to).to_bytes(to) for b in bits[begin:last]), np.uint64).reshape(last - begin, -1)
        step = max(1, (1 << 19) // ((last - begin) * (to // 8)))
        for i in range(begin, end, step):
            i2 = min(i + step, end)
            j2 = int(np.searchsorted(n, n[i2 - 1] * 5 // 4, "right"))
            left, right = np.arange(i, i2), np.arange(i, j2)
            good = (left[:, None] < right) & (root[left, None] != root[right]) & (5 * n[left, None] >= 4 * n[right])
            if cross:
                good &= c[left, None] != c[right]
            p, q = np.nonzero(good)
            p, q = left[p], right[q]
            far = np.bitwise_count(w[p - begin] ^ w[q - begin]).sum(1, dtype=np.int64)
            near = 9 * far <= n[p] + n[q]
            p, q, far = p[near], q[near], far[near]
            if nearest:
                for s, t in ((p, q), (q, p)):
                    order = np.argsort(-far, kind="stable")
                    s, t, d = s[order], t[order], far[order]
                    np.minimum.at(best, s, d)
                    hit = best[s] == d
                    best_at[s[hit]] = t[hit]
            else:
                us.append(p)
                vs.append(q)
    if nearest:
        found = np.flatnonzero(best < 1 << 30)
        return found, best_at[found]
    return np.concatenate(us), np.concatenate(vs)


def _across(groups: DataFrame, distinct: DataFrame, edges: DataFrame, most: int, nearest: bool) -> DataFrame:
    """(u, v) pairs of one group but of different components whose sizes and parities allow 0.8; of each node its nearest, or all.

    A group of over ``most`` is cut into chunks, and every two chunks meet in a task of their own, so no pair is lost.
    """
    to = stars(edges)
    members = groups.join(to.withColumnsRenamed({"u": "node", "v": "root"}), "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = cut(members, "near-members")
    mixed = members.groupBy("token").agg((F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("token")
    some = members.join(mixed, "token", "left_semi").join(distinct.select("node", "bits"), "node")
    chunks = F.ceil(F.col("size") * 2 / F.lit(most))
    some = some.withColumn("chunks", F.when(F.col("size") > most, chunks).otherwise(F.lit(1)).cast("long"))
    some = some.withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    some = some.withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")})
    columns = ["token", "low", "high", "chunk", "node", "n", "root", "bits"]

    def pairs(batches):
        for pdf in _groups(batches, columns, ["token", "low", "high"]):
            key = pdf[["token", "low", "high"]].to_numpy()
            at = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, len(key)]
            chunk, node, n, root = (pdf[c].to_numpy(np.int64) for c in ("chunk", "node", "n", "root"))
            bits = pdf["bits"].to_numpy()
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(at, at[1:], strict=False):
                own = a + np.argsort(n[a:b], kind="stable")
                parts = (x[own] for x in (chunk, n, root, bits))
                cross = bool(key[a, 1] != key[a, 2])
                if b - a <= 24:
                    i, j = _nearest(*(x.tolist() for x in parts), cross, nearest)
                else:
                    i, j = _nearest_of_many(*parts, cross, nearest)
                us.append(node[own[i]] if len(i) else us[0])
                vs.append(node[own[j]] if len(j) else vs[0])
            u, v = np.concatenate(us), np.concatenate(vs)
            yield pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)}).drop_duplicates()

    by = ["token", "low", "high"]
    found = some.select(*columns).repartition(*by).sortWithinPartitions(*by).mapInPandas(pairs, "u long, v long")
    found = cut(found.distinct(), "near-pairs")
    discard(members, to)
    return found


def near_clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = GROUP) -> DataFrame:
    """(id, th, root, component_id) of every document, linked where sets of shingles of five words are similar by 0.8 or more.

    Two sets similar by 0.8 share one of the first fifth of their hashes (and one more) under any order of all hashes; the
    order used puts rare ones first. Texts with a common hash there form a group. First come the pairs of the fingerprints'
    trie self-join and each text with its groups' first, then the nearest of another component, then all that are still in
    another component. Components are those of all pairs.

    Sets are told apart by 64 bits of hash. Where a second hash shows that two sets share the first, one of them has no
    root, so that no text goes for a chance agreement. th is a hash of the text.
    """

    @F.pandas_udf("node long, second long, fp long, n int, bits binary, counts binary")
    def shapes_of(text: pd.Series) -> pd.DataFrame:
        out, total = [], np.zeros(1 << BUCKET_BITS, np.uint32)
        for t in text:
            h = shingle_set(t)
            out.append((_node(h), _node(h, SEED + 1), _print_of(h), len(h), _parity(h)))
            np.add.at(total, (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.uint32(1))
        counts = [zlib.compress(total.tobytes(), 1), *[None] * (len(out) - 1)][: len(out)]  # the batch's counts go with its first row
        return pd.DataFrame(out, columns=["node", "second", "fp", "n", "bits"]).assign(counts=counts)

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), shapes_of(F.col(text_col)).alias("p")).select("id", "th", "p.*")
    rows = cut(rows, "near-rows")
    one = [F.any_value(c).alias(c) for c in ("fp", "n", "bits")]
    distinct = cut(rows.groupBy("node").agg(*one, F.min("id").alias("least"), F.min("second").alias("first_second")), "near-distinct")
    shared = _shared(docs, text_col, _bucket_counts(rows))
    pairs = _star(shared, distinct)
    edges = _verified(pairs, rows, docs, id_col, text_col)
    sizes = shared.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.max("salt").alias("salt"))
    sizes = sizes.where("size > 2 or size > 1 and salt >= 0").drop("salt")  # of two in one task, each has met the other
    groups = cut(shared.select("token", "node", "n").join(sizes, "token"), "near-groups")
    discard(pairs, shared)
    for nearest in (True, False):
        pairs = _across(groups, distinct, edges, most, nearest)
        if not pairs.isEmpty():
            more = _verified(pairs, rows, docs, id_col, text_col)
            both = cut(edges.unionByName(more), "near-edges")
            discard(edges, more)
            edges = both
        discard(pairs)
    discard(groups)
    named = _connected(distinct.select("node", "least", "first_second"), edges)
    discard(distinct, edges)
    own = F.col("second") == F.col("first_second")
    rows = rows.select("id", "th", "node", "second").join(named, "node")
    return rows.select(F.col("id").alias(id_col), "th", F.when(own, F.col("root")).alias("root"), F.when(own, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return clusters(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the least id of each component by similarity, with all its columns; of rows with one id and text, any."""
    rows = near_clusters(docs, id_col, text_col).select(F.col(id_col).alias("id"), "th", "root")
    rows = cut(rows.groupBy("root", "id", "th").agg(F.count(F.lit(1)).alias("times")), "near-rooted")
    least = rows.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "th")).alias("x"))
    first = rows.join(least, "root", "left").withColumn("stays", F.col("root").isNull() | (F.col("id").eqNullSafe(F.col("x.id")) & (F.col("th") == F.col("x.th"))))
    marks = cut(first.where("not stays or times > 1").select(F.col("id").alias("k"), F.col("th").alias("h"), "stays"), "near-marks")
    discard(rows)
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"))
    mine = F.col("id").eqNullSafe(F.col("k")) & (F.col("th") == F.col("h"))
    kept = whole.join(marks, mine, "left_anti")
    if not marks.where("stays").isEmpty():  # rows that repeat an id and text
        kept = kept.unionByName(whole.join(marks.where("stays"), mine, "left_semi").dropDuplicates(["id", "th"]))
    return kept.select(*(F.col("doc")[c].alias(c) for c in docs.columns))


def stage(spark, docs, sf_dir):
    """One document of each group of near-duplicates."""
    return one_each(docs)
