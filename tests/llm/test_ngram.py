import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import docs, store
from pyspark.sql import functions as F

from tessella.llm import ngram
from tessella.llm.common import WORD, ascii_lower
from tessella.llm.eliasfano import Sequence, Trie, decode, encode, probability, quantised


def brute(rows, order=3):
    """The model by plain counting over all texts."""
    texts = [(k, ["<s>", *WORD.findall(ascii_lower(t or "")), "\n"]) for k, t in rows]
    held = [zlib.crc32(str(k).encode()) % 10 == 0 if k is not None else True for k, _ in texts]
    uni, bi, tri = Counter(), Counter(), Counter()
    for (_, w), h in zip(texts, held, strict=True):
        if not h:
            uni.update(w)
            bi.update(zip(w, w[1:], strict=False))
            tri.update(zip(w, w[1:], w[2:], strict=False))
    n, v = sum(uni.values()) - uni["<s>"], len([w for w in uni if w != "<s>"])

    def smoothed(grams):
        d = ngram.discount(*(sum(c == k for c in grams.values()) for k in (1, 2)))
        left, whole = Counter(), Counter()
        for g, c in grams.items():
            left[g[:-1]] += d
            whole[g[:-1]] += c
        return lambda g, lower: (max(grams[g] - d, 0) + left[g[:-1]] * lower) / whole[g[:-1]] if whole[g[:-1]] else lower

    two, three = smoothed(bi), smoothed(tri)
    out = []
    for (k, w), h in zip(texts, held, strict=True):
        base = score = 0.0
        for i in range(1, len(w)):
            p1 = (uni[w[i]] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p1)
            p = two((w[i - 1], w[i]), p1)
            score += math.log10(three((w[i - 2], w[i - 1], w[i]), p) if i > 1 and order > 2 else p)
        out.append((k, h, len(w) - 1, sum(uni[x] > 0 for x in w[1:]), n, round(base, 6), score))
    return out


def as_rows(frame):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.score) for r in frame.collect()), key=str)


def same(got, want):
    want = sorted(want, key=str)
    assert [g[:6] for g in got] == [w[:6] for w in want]
    assert [g[6] for g in got] == pytest.approx([w[6] for w in want], rel=1e-4, abs=1e-3)


def corpus(n=300, seed=2):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeÉé", k=r.randint(1, 5))) for _ in range(400)]
    rows = [(k, " ".join(r.choices(words, weights=[1 / (i + 1) for i in range(400)], k=r.randint(0, 80)))) for k in range(n)]
    return rows + [(None, "a B c"), (5, None), (6, ""), (7, "x" * 40000), (1, rows[1][1]), (1, rows[1][1])]


def test_against_plain_counting(spark, tmp_path):
    rows = corpus()
    same(as_rows(ngram.query(spark, store(spark, tmp_path, "documents", docs(spark, rows)))), brute(rows))


@pytest.mark.parametrize("order", [2, 3])
def test_many_chunks_and_shards(spark, monkeypatch, order):
    """Discounts are those of the whole corpus, however it is dealt out; hot contexts are spread."""
    monkeypatch.setattr(ngram, "CHUNK", 500)
    rows = corpus()
    frame = docs(spark, rows).select("doc_id", "text").repartition(3)
    assert ngram.chunks(frame, "doc_id", "text").count() > 1
    same(as_rows(ngram.score(frame, order=order)), brute(rows, order))
    monkeypatch.setattr(ngram, "SHARD", 400)
    same(as_rows(ngram.score(frame, order=order)), brute(rows, order))


def test_ids_stay_exact(spark):
    big = 9007199254740993
    frame = docs(spark, [(big, "a b"), (None, "a"), (big + 1, "a b c")]).select("doc_id", "text")
    assert {r.doc_id for r in ngram.score(frame).collect()} == {big, big + 1, None}
    named = frame.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    assert {r.doc_id for r in ngram.score(named).collect()} == {str(big), str(big + 1), None}


def test_held_out_texts_and_repeated_ones(spark):
    rows = ngram.query(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 50 and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_a_text_that_comes_twice_scores_higher(spark):
    r = random.Random(4)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(300)]
    texts = [" ".join(r.choices(words, k=60)) for _ in range(120)]
    rows = list(enumerate(texts + texts[:30]))
    got = {x.doc_id: x.score / x.n_tokens for x in ngram.score(docs(spark, rows).select("doc_id", "text")).collect() if not x.held_out}
    twice = [v for k, v in got.items() if (k < 30 and k + 120 in got) or (k >= 120 and k - 120 in got)]
    once = [v for k, v in got.items() if 30 <= k < 120]
    assert len(twice) > 30 and min(twice) > max(once)


def test_empty(spark):
    assert ngram.score(docs(spark, []).select("doc_id", "text")).count() == 0


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 0), (1, 5), (10, 3), (1000, 10), (1000, 10**9), (5000, 2**40), (300, 300)])
def test_sequences(n, top):
    r = np.random.default_rng(1)
    values = np.sort(r.integers(0, top + 1, n)).astype(np.uint64)
    s = Sequence(values)
    assert n == 0 or (s[np.arange(n)] == values).all()
    asked = np.r_[values, r.integers(0, top + 5, 200).astype(np.uint64)]
    at = s.find(asked)
    assert ((at >= 0) == np.isin(asked, values)).all() and (values[at[at >= 0]] == asked[at >= 0]).all()
    few = np.concatenate([s.find(asked[k : k + 3]) for k in range(0, len(asked), 3)])  # by selects, where the sequence is long
    assert ((few >= 0) == (at >= 0)).all() and (values[few[few >= 0]] == asked[few >= 0]).all() and (s.values() == values).all()


def test_trie():
    r = np.random.default_rng(3)
    key = np.unique((r.zipf(1.3, 20000) % 300).astype(np.uint64) << np.uint64(32) | (r.zipf(1.2, 20000) % 5000).astype(np.uint64))
    v, w = key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)
    codes = encode(r.zipf(1.2, len(key)) % 10**9 + 1)
    for context in (v, v << np.uint64(40) | np.uint64(7)):
        lone = np.setdiff1d(np.arange(0, 700, 3, dtype=np.uint64) << np.uint64(3), context)  # contexts without followers
        keys = np.union1d(context, lone)
        sizes = np.searchsorted(context, keys, "right") - np.searchsorted(context, keys)
        trie = Trie(keys, sizes, w, codes, np.arange(len(keys)))
        place, left = trie.left_of(context)
        assert (left == np.searchsorted(keys, context)).all() and (trie.codes_of(place, w) == codes).all()
        for k in range(0, len(w), 211):
            assert trie.codes_of(place[k : k + 1], w[k : k + 1]) == codes[k]
        other = w + np.uint64(1)
        assert ((trie.codes_of(place, other) > 0) == np.isin(v << np.uint64(32) | other, key)).all()
        for missing in (lone, keys[-1:] + np.uint64(1)):
            place, left = trie.left_of(missing)
            assert (place >= 0).all() == (missing is lone) and not trie.codes_of(place, np.zeros(len(place), np.uint64)).any()


def test_all_scores_come_from_the_trie(monkeypatch):
    """Without what the trie finds, every token that the model knows in its context has another probability."""
    r = np.random.default_rng(5)
    n, words = 4000, 50
    context, word, train = r.integers(0, words, n), r.zipf(1.4, n).astype(np.uint64) % np.uint64(words), r.random(n) < 0.8
    total = np.bincount(context[train], minlength=words).astype(float)
    totals = ngram.Totals([])
    level = ngram.Level(context, np.arange(words, dtype=np.uint64), total, word, train, np.zeros(words, bool), totals)
    lower = np.full(n, 1 / words)
    whole = level.p(lower, 0.5)
    count = np.zeros((words, words))
    np.add.at(count, (context[train], word[train].astype(int)), 1)
    want = (np.maximum(count - 0.5, 0) + 0.5 * (count > 0).sum(1, keepdims=True) / words) / total[:, None]
    assert whole == pytest.approx(want[context, word.astype(int)], rel=4e-4)
    known = count[context, word.astype(int)] > 0
    monkeypatch.setattr(Trie, "codes_of", lambda self, place, word: np.zeros(len(place), np.uint16))
    assert (level.p(lower, 0.5)[known] < whole[known]).all()
    monkeypatch.setattr(Trie, "left_of", lambda self, context: (np.full(len(context), -1), np.zeros(len(context), np.uint16)))
    assert (level.p(lower, 0.5) == lower).all()


def test_probabilities():
    p = np.r_[1.0, 0.5, 10.0 ** -np.arange(1, 18)]
    assert probability(quantised(p)) == pytest.approx(p, rel=4e-4) and probability(quantised(p))[0] == 1 and probability(np.zeros(1, np.uint16))[0] == 0


def test_codebook():
    c = np.r_[np.arange(5000), 10 ** np.arange(4, 15)]
    assert decode(encode(c)) == pytest.approx(c, rel=4e-4) and (decode(encode(c[:4097])) == c[:4097]).all()
    assert ngram.discount(100, 50) == 0.5 and 0 < ngram.discount(0, 0) < ngram.discount(9, 0) < 1
