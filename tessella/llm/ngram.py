"""Language-model scoring with a trigram model in Elias-Fano tries.

p3(w | u v) = max(c(u v w) - D, 0) / c(u v) + g(u v) p2(w | v), and p2 likewise over the smoothed unigram
p1(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)): absolute discounting, with D = n1 / (n1 + 2 n2) of each order from the numbers
of pairs that the whole corpus has once and twice; g is what the discounts leave. (A discount of its own for a count of
two suffers where many texts come twice: they leave hardly a count of three.) A context that no training text has leaves
the lower order as it is. A text is its words, A-Z lower-cased, and one end; its first word follows a beginning, and so is scored by
p2. Words of no training text share one unknown word.

The model is too large for one machine, so it is dealt out and asked. Documents are packed into chunks of about
``CHUNK`` tokens with a vocabulary each. A chunk sends its words, with their training counts, to shards by hash; a shard
sums them and answers each chunk with the words' numbers and counts. Then, order by order, the chunk sends its distinct
(context, word) pairs, with their training counts, to shards of contexts; each shard sums them and answers with codes of
counts and, for each context, its number of followers. Shards also report their counts of counts, which make the
corpus-wide discounts. A shard of bigrams says as well which of them several chunks have; the trigrams behind the others
are resolved in their chunk and never sent. A context with more than its share of tokens is spread over shards by the
following word. Shards hold about ``SHARD`` tokens' entries, however large the corpus. A chunk has a message for a shard
only if it has entries there, so messages are no more than distinct words and pairs of chunks, and grow with the input.

With the discounts, each order's part of the model that a chunk needs becomes a trie (see ``eliasfano``) of quantised
smoothed probabilities and of what each context leaves to the lower order. Scores of all tokens are read from the tries;
only p1, which the base score needs exactly, comes from counts. Scores do not depend on how many shards or chunks there are.

Nulls: a null text is empty and scores its end; a null id is in fold 0, held out. Ids of any kind that a string can hold
stay exact. Repeated rows are scored, and learnt from, each. Without training rows p1 is 0.1 / 0.1. Empty in, empty out.
Columns of any other name are not read. Up to 2^32 distinct words.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WORD, ascii_lower, cut
from tessella.llm.eliasfano import Trie, decode, encode, probability, quantised

CHUNK, SHARD, ALPHA, FOLDS, SEED, ORDER = 1_000_000, 1_500_000, 0.1, 10, 42, 3
#: The end of a text: a string that no word can be.
END = "\n"
U = np.uint64
LOW = U(0xFFFFFFFF)


def press(a: np.ndarray) -> bytes:
    """An array by byte planes, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def unpress(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def steps(a: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers."""
    return np.diff(a, prepend=a.dtype.type(0))


def chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents packed by chunk: ids, folds, token counts (end included), and tokens as ranks of the chunk's words by number."""
    fold = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % FOLDS
    rows = docs.select(F.col(id_col).cast("string").alias("id"), (fold == 0).alias("held"), F.col(text_col).alias("text"))

    def pack(batches):
        def empty():
            places = defaultdict()
            places.default_factory = places.__len__  # a new word gets the next place
            return [], [], [], [], places

        ids, held, sizes, parts, places = empty()
        total = 0

        def done():
            hashes = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), SEED) for w in places], U)
            order = np.argsort(hashes)
            turn = np.empty(len(order), np.int64)
            turn[order] = np.arange(len(order))
            tokens = turn[np.concatenate(parts)]
            every = np.bincount(tokens, minlength=len(order)).astype(np.uint32)
            train = np.bincount(tokens[~np.repeat(np.array(held, bool), sizes)], minlength=len(order)).astype(np.uint32)
            rank = np.empty(len(order), np.uint32)
            rank[ranked(every)] = np.arange(len(order), dtype=np.uint32)
            row = {"chunk": uuid.uuid4().hex, "ids": ids, "held": held, "sizes": sizes, "tokens": press(rank[tokens]), "words": hashes[order].tobytes(), "counts": press(train), "every": press(every)}
            return pd.DataFrame({k: [v] for k, v in row.items()})

        for pdf in batches:
            for i, h, text in zip(pdf["id"], pdf["held"], pdf["text"], strict=True):
                words = WORD.findall(ascii_lower(text or ""))
                words.append(END)
                parts.append(np.fromiter(map(places.__getitem__, words), np.uint32, len(words)))
                ids.append(i)
                held.append(bool(h))
                sizes.append(len(words))
                total += len(words)
                if total >= CHUNK:
                    yield done()
                    ids, held, sizes, parts, places = empty()
                    total = 0
        if ids:
            yield done()

    return rows.mapInPandas(pack, "chunk string, ids array<string>, held array<boolean>, sizes array<int>, tokens binary, words binary, counts binary, every binary")


def ranked(counts: np.ndarray) -> np.ndarray:
    """Places by count, the largest first: frequent words get small ranks, which compress well."""
    return np.argsort(-counts.astype(np.int64), kind="stable")


def vocabulary(packed: DataFrame, shards: int) -> DataFrame:
    """(chunk, shard, n, v, u, number, count): each chunk's words of each shard, in order of hash, and the shards' totals."""

    def send(batches):
        for pdf in batches:
            for chunk, words, counts in zip(pdf["chunk"], pdf["words"], pdf["counts"], strict=True):
                words, counts = np.frombuffer(words, U), unpress(counts, np.uint32)
                present, edges = _runs((words >> U(32)) * U(shards) >> U(32))  # ranges of hashes
                parts = list(zip(edges, edges[1:], strict=False))
                yield pd.DataFrame({"shard": present, "chunk": chunk, "words": [words[a:b].tobytes() for a, b in parts], "counts": [press(counts[a:b]) for a, b in parts]})

    def answer(pdf):
        words = [np.frombuffer(w, U) for w in pdf["words"]]
        sizes = np.cumsum([0, *map(len, words)])
        known, place = np.unique(np.concatenate(words), return_inverse=True)
        count = np.bincount(place, np.concatenate([unpress(c, np.uint32) for c in pdf["counts"]]), len(known)).astype(np.uint64)
        out = {"chunk": [None, *pdf["chunk"]], "shard": int(pdf["shard"].iloc[0]), "n": int(count.sum()), "v": int((count > 0).sum()), "u": len(known)}
        parts = [place[a:b] for a, b in zip(sizes, sizes[1:], strict=False)]
        # a chunk's words of a shard ascend by hash, and so do their numbers
        return pd.DataFrame(out | {"number": [None, *(press(steps(p).astype(np.uint32)) for p in parts)], "count": [None, *(press(count[p]) for p in parts)]})

    rows = packed.select("chunk", "words", "counts").mapInPandas(send, "shard int, chunk string, words binary, counts binary")
    return rows.groupBy("shard").applyInPandas(answer, "chunk string, shard int, n long, v long, u long, number binary, count binary")


def _runs(ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, and where each one's run begins, with the end."""
    first = np.flatnonzero(np.r_[len(ascending) > 0, ascending[1:] != ascending[:-1]])
    return ascending[first].astype(np.int64), np.r_[first, len(ascending)]


class Totals:
    """Corpus-wide numbers: tokens, distinct words, each vocabulary shard's first number, and shards of contexts."""

    def __init__(self, rows):
        by = {r.shard: r for r in rows}
        self.n, self.v = sum(r.n for r in rows), sum(r.v for r in rows)
        self.shards = max(by, default=0) + 1
        self.first = np.cumsum([0, *(by[s].u if s in by else 0 for s in range(self.shards))]).astype(np.uint64)
        self.contexts = self.n // SHARD + 1
        if int(self.first[-1]) + 1 >= 1 << 32:
            raise ValueError("over 2^32 distinct words")

    def p1(self, count: np.ndarray) -> np.ndarray:
        return (count + ALPHA) / (self.n + ALPHA * (self.v + 1))

    def spread(self, count: np.ndarray) -> np.ndarray:
        """Over how many shards a context of this count is spread."""
        share = max(1.0, self.n / (8 * self.contexts))
        return np.minimum(self.contexts, 1 + (count // share)).astype(np.int64)


def discount(once: int, twice: int) -> float:
    """D from the numbers of pairs seen once and twice."""
    return min(max(once / max(once + 2 * twice, 1), 0.05), 0.95)


class Level:
    """A chunk's distinct (context, word) pairs of one order, what it asks of which shard, and what is answered.

    ``context`` says for each token which of ``keys`` (ascending) it follows, ``total`` how often training texts have that
    context, ``ask`` whether shards must be asked about it; a known context that isn't asked about is wholly in the chunk.
    """

    def __init__(self, context, keys, total, word, train, ask, totals: Totals):
        packed, self.pair = np.unique(context.astype(U) << U(32) | word, return_inverse=True)
        self.of, self.word = (packed >> U(32)).astype(np.int64), packed & LOW
        self.c = np.bincount(self.pair[train], minlength=len(packed)).astype(np.uint32)
        self.keys, self.total, self.shards = keys, total, totals.contexts
        used = np.zeros(len(keys), bool)
        used[self.of] = True
        self.ask = ask & used & (total > 0)
        k = np.where(self.ask, totals.spread(total), 1)
        mix = (keys * U(0x9E3779B97F4A7C15) >> U(33)).astype(np.int64)
        asked = np.flatnonzero(self.ask[self.of])
        part = (self.word[asked] * U(0xC2B2AE3D27D4EB4F) >> U(33)).astype(np.int64) % k[self.of[asked]]
        shard = (mix[self.of[asked]] + part) % self.shards
        order = np.argsort(shard.astype(np.uint16) if self.shards < 1 << 16 else shard, kind="stable")  # by radix, if small
        self.order, shard = asked[order], shard[order]
        self.places = shard.astype(np.int32)
        wide = np.flatnonzero(k > 1)  # of a spread context, shards that get none of its pairs are asked for their part as well
        which = np.repeat(wide, k[wide])
        place = np.arange(len(which)) - np.repeat(np.cumsum(k[wide]) - k[wide], k[wide])
        own = np.flatnonzero(k[self.of[self.order]] > 1)
        more = np.setdiff1d((mix[which] + place) % self.shards * len(keys) + which, shard[own] * len(keys) + self.of[self.order[own]])
        self.more, more_shard = more % max(1, len(keys)), more // max(1, len(keys))  # ascending by shard
        self.more_places = more_shard.astype(np.int32)
        self.code, self.followers, self.shared = np.zeros(len(packed), np.uint16), np.zeros(len(keys), np.int64), np.zeros(len(packed), bool)
        inside = np.flatnonzero((total > 0) & used & ~self.ask)  # resolved here
        mine = np.zeros(len(keys), bool)
        mine[inside] = True
        own = np.flatnonzero(mine[self.of])
        self.code[own] = encode(self.c[own])
        some = own[self.c[own] > 0]
        self.followers += np.bincount(self.of[some], minlength=len(keys))
        self.tally = [int((self.c[own] == k).sum()) for k in (1, 2)]

    def _of(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs, and the further contexts, that shard s is asked about."""
        a, b = np.searchsorted(self.places, [s, s + 1])
        c, d = np.searchsorted(self.more_places, [s, s + 1])
        return self.order[a:b], self.more[c:d]

    def requests(self, own: int):
        """(shard, contexts of pairs, words, counts, further contexts, tally); the tally goes to the shard ``own``."""
        for s in np.unique(np.r_[self.places, self.more_places, own]).tolist():
            pairs, more = self._of(s)
            v, w = steps(self.keys[self.of[pairs]]), self.word[pairs]
            w[1:] -= np.where(v[1:] == 0, w[:-1], U(0))  # words ascend inside a context
            yield s, press(v), press(w.astype(np.uint32)), press(self.c[pairs]), press(self.keys[more]), *(self.tally if s == own else (0, 0))

    def answer(self, rows: pd.DataFrame) -> None:
        for s, codes, followers, shared in zip(rows["shard"], rows["number"], rows["count"], rows["shared"], strict=True):
            mine, more = self._of(s)
            self.code[mine] = unpress(codes, np.uint16)
            self.shared[mine] = np.unpackbits(unpress(shared, np.uint8), count=len(mine))
            of = self.of[mine]
            contexts = np.r_[_runs(of)[0], more]
            self.followers[contexts] += unpress(followers, np.uint32)  # a shard has a context once

    def trie(self, d: float) -> Trie:
        """The contexts that training texts have, what they leave to the lower order, and their words' smoothed probabilities."""
        known, seen = np.flatnonzero(self.total > 0), np.flatnonzero(self.code > 0)
        of = self.of[seen]
        codes = quantised((decode(self.code[seen]) - d) / self.total[of])
        left = quantised(self.followers[known] * d / self.total[known])
        return Trie(self.keys[known], np.bincount(of, minlength=len(self.keys))[known], self.word[seen], codes, left)

    def p(self, lower: np.ndarray, d: float) -> np.ndarray:
        """Each token's probability over the lower order's, from the trie; a context that it lacks leaves all to the lower order."""
        trie = self.trie(d)
        place, left = trie.left_of(self.keys)
        left = np.where(place >= 0, probability(left), 1.0)
        smooth = probability(trie.codes_of(place[self.of], self.word))
        return smooth[self.pair] + left[self.of][self.pair] * lower


class Chunk:
    """A chunk with its words' numbers and counts, and the levels as far as they are answered."""

    def __init__(self, row, gathered: pd.DataFrame, totals: Totals, answered: int, deep: bool):
        self.t, self.held, self.sizes = totals, np.array(row["held"], bool), np.array(row["sizes"], np.int64)
        words = gathered[gathered["kind"] == 1].sort_values("shard")
        number = np.concatenate([np.cumsum(unpress(x, np.uint32), dtype=U) + totals.first[s] for x, s in zip(words["number"], words["shard"], strict=True)])
        count = np.concatenate([unpress(x, np.uint64) for x in words["count"]])
        tokens = ranked(unpress(row["every"], np.uint32))[unpress(row["tokens"], np.uint32)]
        self.count, w = count[tokens], number[tokens]
        ends = np.cumsum(self.sizes) - 1
        self.starts = ends + 1 - self.sizes
        train = ~np.repeat(self.held, self.sizes)
        # the beginning: the number after the last word, as often as there are training texts, which is the end's count
        v, before = np.r_[U(0), w[:-1]], np.r_[U(0), self.count[:-1]]
        v[self.starts], before[self.starts] = totals.first[-1], self.count[ends[0]]
        keys, place = np.unique(v, return_inverse=True)
        total = np.zeros(len(keys))
        total[place] = before
        self.levels = [Level(place, keys, total, w, train, np.ones(len(keys), bool), totals)]
        self.inner = np.ones(len(w), bool)
        self.inner[self.starts] = False
        for k in range(2, answered + 1):
            self.levels[-1].answer(gathered[gathered["kind"] == k])
            if k == 2 and deep:
                self._deepen(w, train)

    def _deepen(self, w: np.ndarray, train: np.ndarray) -> None:
        """The trigrams: contexts are the bigrams, asked about where other chunks have them too."""
        two = self.levels[-1]
        mine = np.flatnonzero(self.inner)
        self.levels.append(Level(two.pair[mine - 1], two.keys[two.of] << U(32) | two.word, decode(two.code), w[mine], train[mine], two.shared, self.t))

    def scores(self, ids: list, d: list[float]) -> pd.DataFrame:
        p1 = self.t.p1(self.count)
        p = self.levels[0].p(p1, d[0])
        if len(self.levels) > 1:
            p[self.inner] = self.levels[1].p(p[self.inner], d[1])

        def add(x):
            return np.add.reduceat(x, self.starts)

        known = add((self.count > 0).astype(np.int64))
        return pd.DataFrame({"id": ids, "held_out": self.held, "n_tokens": self.sizes, "n_known": known, "train_tokens": self.t.n, "base_score": add(np.log10(p1)), "score": add(np.log10(p))})


def pairs_of(contexts: bytes, words: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A request's distinct contexts, how many words each has, and the words, from their differences."""
    step, total = unpress(contexts, U), np.cumsum(unpress(words, np.uint32), dtype=U)
    if not len(step):
        return step, np.zeros(0, np.int64), total
    starts = np.flatnonzero(np.r_[True, step[1:] != 0])
    sizes = np.diff(np.r_[starts, len(step)])
    return np.cumsum(step, dtype=U)[starts], sizes, total - np.repeat(np.r_[U(0), total[starts[1:] - 1]], sizes)


def shard_answers(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard of contexts: sums, its answers to every chunk's requests, and its counts of counts."""
    asked = [(*pairs_of(v, w), unpress(m, U)) for v, w, m in zip(pdf["v"], pdf["w"], pdf["more"], strict=True)]
    known, place = np.unique(np.concatenate([x for keys, _, _, more in asked for x in (keys, more)]), return_inverse=True)
    contexts, pairs, at = [], [], 0
    for keys, sizes, words, more in asked:
        own = place[at : at + len(keys) + len(more)]
        contexts.append(own)
        pairs.append(np.repeat(own[: len(keys)], sizes).astype(U) << U(32) | words)
        at += len(own)
    key, place = np.unique(np.concatenate(pairs), return_inverse=True)
    c = np.bincount(place, np.concatenate([unpress(x, np.uint32) for x in pdf["c"]]), len(key)).astype(np.int64)
    followers = np.bincount((key[c > 0] >> U(32)).astype(np.int64), minlength=len(known)).astype(np.uint32)
    codes = encode(c)
    ends = np.cumsum([0, *map(len, pairs)])
    out = {"chunk": [None, *pdf["chunk"]], "shard": int(pdf["shard"].iloc[0])}
    out["number"] = [None, *(press(codes[place[a:b]]) for a, b in zip(ends, ends[1:], strict=False))]
    out["count"] = [None, *(press(followers[x]) for x in contexts)]
    several = np.bincount(place, minlength=len(key)) > 1  # each request has a pair once
    out["shared"] = [None, *(press(np.packbits(several[place[a:b]])) for a, b in zip(ends, ends[1:], strict=False))]
    return pd.DataFrame(out | {f"t{k}": int((c == k).sum() + pdf[f"t{k}"].sum()) for k in (1, 2)})


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; ``order``: 2 or 3."""
    order = ORDER if order is None else order
    packed = cut(chunks(docs, id_col, text_col), "ngram-chunks")
    entries = packed.agg(F.sum(F.length("words") / 8)).first()[0] or 0
    shards = int(entries // SHARD) + 1
    words = cut(vocabulary(packed, shards), "ngram-words")
    totals = Totals(words.where("chunk is null").select("shard", "n", "v", "u").collect())  # a row for each shard
    gathered = words.where("chunk is not null").select("chunk", "shard", "number", "count", F.lit(None).cast("binary").alias("shared"), F.lit(1).alias("kind"))
    body = packed.select("chunk", "held", "sizes", "tokens", "every")
    tables, d = [], []

    def asking(k):
        def ask(left, right):
            row = left.iloc[0]
            level = Chunk(row, right, totals, k - 1, order > 2).levels[k - 2]
            requests = level.requests(zlib.crc32(row["chunk"].encode()) % totals.contexts)
            return pd.DataFrame([(row["chunk"], *r) for r in requests], columns=["chunk", "shard", "v", "w", "c", "more", "t1", "t2"])

        return ask

    for k in range(2, order + 1):
        asks = body.groupBy("chunk").cogroup(gathered.groupBy("chunk"))
        asks = asks.applyInPandas(asking(k), "chunk string, shard int, v binary, w binary, c binary, more binary, t1 long, t2 long")
        answers = asks.groupBy("shard").applyInPandas(shard_answers, "chunk string, shard int, number binary, count binary, shared binary, t1 long, t2 long")
        tables.append(cut(answers, f"ngram-answers-{k}"))
        tally = tables[-1].where("chunk is null").agg(F.sum("t1"), F.sum("t2")).first()
        d.append(discount(*(x or 0 for x in tally)))
        gathered = gathered.unionByName(tables[-1].where("chunk is not null").select("chunk", "shard", "number", "count", "shared", F.lit(k).alias("kind")))

    def finish(left, right):
        row = left.iloc[0]
        return Chunk(row, right, totals, order, order > 2).scores(list(row["ids"]), d)

    schema = "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = packed.select("ids", *body.columns).groupBy("chunk").cogroup(gathered.groupBy("chunk")).applyInPandas(finish, schema)
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *out.columns[1:])


def query(spark, sf_dir):
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
