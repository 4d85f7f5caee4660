import random

import numpy as np
import pytest
import xxhash
from helpers import clashing, docs, store

from tessella.llm import simhash
from tessella.llm.common import WORD, ascii_lower


def brute_print(text):
    words = WORD.findall(ascii_lower(text or ""))
    if not words:
        return 0
    parts = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    """Union of all pairs of distinct fingerprints within 3 bits."""
    distinct = np.array(sorted(set(prints)), np.uint64)
    root = np.arange(len(distinct))
    for k in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(distinct ^ distinct[k]) <= 3):
            a, b = root[k], root[j]
            if a != b:
                root[root == max(a, b)] = min(a, b)
    return dict(zip(distinct.tolist(), root.tolist(), strict=True))


def test_whole_table_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    prints = {k: brute_print(t) for k, t in texts.items()}
    comp = brute_components(prints.values())
    least = {}
    for k, p in prints.items():
        least[comp[p]] = min(k, least.get(comp[p], k))
    got = simhash.query(spark, d).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {k: (f"{p:016x}", least[comp[p]]) for k, p in prints.items()}
    assert len({r.component_id for r in got}) < len(got)


@pytest.mark.parametrize("most", [100_000, 40, 3])
def test_clustered_prints_in_small_groups(spark, most):
    r = random.Random(7)
    near = []
    for c in [r.getrandbits(64) for _ in range(12)]:
        for _ in range(60):
            near.append(c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))))
    prints = sorted(set(near + [r.getrandbits(64) for _ in range(300)] + [0, (1 << 64) - 1]))
    frame = spark.createDataFrame([(simhash._signed(p), simhash._signed(p)) for p in prints], "node long, fp long")
    found = {(e.u, e.v) for e in simhash.stars(simhash.links(frame, most=most)).collect()}
    root = {simhash._signed(p): simhash._signed(p) for p in prints} | dict(found)
    comp = brute_components(prints)
    assert len(set(root.values())) == len(set(comp.values()))
    assert len({(root[simhash._signed(p)], comp[p]) for p in prints}) == len(set(comp.values()))


def test_trie_links_and_blocks():
    for used in [0, *simhash._blocks(0)]:
        parts = simhash._blocks(used)
        assert len(parts) == 4 and parts[0] | parts[1] | parts[2] | parts[3] == (1 << 64) - 1
    empty = np.zeros(0, np.uint64)
    assert [len(x) for x in simhash.trie_links(empty, empty)] == [0, 0]


def test_trie_links_are_pairs_that_span():
    r = random.Random(2)
    prints = np.array(sorted({r.getrandbits(64) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 2))) for _ in range(3)} | {c ^ 1 << b for c in [r.getrandbits(64) for _ in range(9)] for b in range(40)}), np.uint64)
    i, j = simhash.trie_links(np.zeros(len(prints), np.int64), prints)
    assert (np.bitwise_count(prints[i] ^ prints[j]) <= 3).all()
    assert len(i) == len(prints) - len(set(brute_components(prints.tolist()).values()))


def test_parities_never_rule_out_similar_sets():
    r = np.random.default_rng(4)
    for n in (1, 3, 60, 70, 127, 128, 129, 500, 3000):
        a = r.integers(0, 1 << 63, n, dtype=np.uint64)
        for gone in (0, 1, n // 20, n // 10, n // 9):
            b = np.unique(np.r_[a[gone:], r.integers(0, 1 << 63, gone, dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            if 5 * both >= 4 * (len(a) + len(b) - both):
                assert simhash._possible(len(a), simhash._parity(a), len(b), simhash._parity(b))
        c = r.integers(0, 1 << 63, n, dtype=np.uint64)
        assert n < 60 or not simhash._possible(n, simhash._parity(a), n, simhash._parity(c))


def test_edges(spark, tmp_path):
    rows = [(5, None), (4, ""), (None, " \t"), (7, "one"), (8, "One"), (8, "One"), (None, "alone here now we"), (9, "w " * 60000)]
    sf = store(spark, tmp_path, "documents", docs(spark, rows))
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.query(spark, sf).collect())
    assert len(got) == 8
    assert {(a, c) for a, f, c in got if f == "0" * 16} == {(0, 4), (4, 4), (5, 4)}
    assert [c for a, _, c in got if a in (7, 8)] == [7, 7, 7]
    kept = simhash.one_each(spark.read.parquet(f"{sf}/documents.parquet"))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 7, 9] and len(kept.columns) == 5
    assert simhash.one_each(docs(spark, [])).count() == 0
    assert simhash.query(spark, store(spark, tmp_path / "e", "documents", docs(spark, []))).count() == 0


def test_repeated_rows_and_clashing_columns(spark):
    frame = docs(spark, [(1, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, "e f g"), (None, "h"), (None, "h")])
    frame = clashing(frame, "_key", "key", "node", "root", "id", "th", "doc", "k", "h", "stays")
    kept = simhash.one_each(frame)
    assert kept.columns == frame.columns and sorted((r.doc_id or 0, r.text, r.key) for r in kept.collect()) == [(0, "h", "own"), (1, "a b c d", "own"), (3, "e f g", "own")]


def test_a_chance_agreement_of_hashes_drops_no_text(spark, monkeypatch):
    whole = simhash._node
    monkeypatch.setattr(simhash, "_node", lambda h, seed=simhash.SEED: 5 if seed == simhash.SEED else whole(h, seed))
    rows = simhash.near_clusters(docs(spark, [(1, "a b c d e f"), (2, "g h i j k l"), (3, "a b c d e f")]))
    roots = {r.doc_id: r.root for r in rows.collect()}
    assert roots[1] == roots[3] and (roots[1] is None) != (roots[2] is None)


@pytest.mark.parametrize("salt", [3, 0])
def test_hot_hashes_are_dealt_to_several_tasks(spark, monkeypatch, salt):
    monkeypatch.setattr(simhash, "SALT", salt or 1)
    texts = edited_texts(seed=12, groups=12) + [" ".join(["same few words come first", *t.split()[:9]]) for t in edited_texts(seed=13, groups=6)]
    assert near_roots(spark, texts) == exact_components(texts)


def test_similar_texts_are_linked(spark):
    """Edited copies with at least 0.8 of their five-word shingles in common; texts that share half stay apart."""
    r = random.Random(11)
    vocab = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(3000)]

    def shingles(words):
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    rows, near, far = [], [], []
    for k in range(300):
        words = r.choices(vocab, k=r.randint(60, 400))
        other = list(words)
        for _ in range(max(1, len(words) // 60)):
            other[r.randrange(len(other))] = r.choice(vocab)
        half = words[: len(words) // 2] + r.choices(vocab, k=len(words) // 2)
        a, b, c = shingles(words), shingles(other), shingles(half)
        if len(a & b) / len(a | b) >= 0.84:
            near.append((3 * k, 3 * k + 1))
        if len(a & c) / len(a | c) < 0.5:
            far.append((3 * k, 3 * k + 2))
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(other).upper()), (3 * k + 2, " ".join(half))]
    root = {x.doc_id: x.component_id for x in simhash.near_clusters(docs(spark, rows)).collect()}
    assert len(root) == 900 and len(near) > 150 and len(far) > 200
    assert all(root[a] == root[b] for a, b in near)
    assert not any(root[a] == root[b] for a, b in far)
    small = {x.doc_id: x.component_id for x in simhash.near_clusters(docs(spark, rows), most=5).collect()}
    assert all(small[a] == small[b] for a, b in near)


def exact_components(texts):
    """{place: root} over all pairs of texts whose sets of five-word shingles are similar by 0.8 or more."""
    sets = []
    for t in texts:
        words = WORD.findall(ascii_lower(t or ""))
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))})
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])) and root[a] != root[b]:
                both = len(sets[a] & sets[b])
                if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                    old, new = max(root[a], root[b]), min(root[a], root[b])
                    root = [new if x == old else x for x in root]
    return root


def near_roots(spark, texts, **more):
    got = {x.doc_id: x.component_id for x in simhash.near_clusters(docs(spark, list(enumerate(texts))), **more).collect()}
    return [got[k] for k in range(len(texts))]


def edited_texts(seed=5, groups=60):
    """Copies on both sides of 0.8, with several edits each."""
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(3000)]
    texts = []
    for _ in range(groups):
        words = r.choices(vocab, k=r.randint(60, 400))
        texts.append(" ".join(words))
        for _ in range(5):
            other = list(words)
            for _ in range(max(1, round(len(words) * r.uniform(0.015, 0.035)))):
                other[r.randrange(len(other))] = r.choice(vocab)
            texts.append(" ".join(other))
    return texts


def test_links_are_those_of_all_pairs(spark):
    """No pair at 0.8 is lost and none below is linked."""
    texts = edited_texts()
    want = exact_components(texts)
    assert 60 < len(set(want)) < 300
    assert near_roots(spark, texts) == want


def test_more_than_512_equal_fingerprints(spark):
    """Unrelated fields between a repeated phrase: one fingerprint for all, and copies among them that are unlike the first."""
    r = random.Random(3)
    fields = [["".join(r.choices("abcdefgh", k=9)) for _ in range(100)] for _ in range(560)]
    fields += [["other" if j % 20 == 3 else x for j, x in enumerate(f)] for f in fields[100:140]]
    texts = [" ".join(f"item is now in stock {x}" for x in f) for f in fields]
    prints = [simhash._print_of(simhash.shingle_hashes(t.split(), 5)) for t in texts]
    assert max(map(prints.count, prints)) > 512
    want = exact_components(texts)
    assert len(set(want)) == 560 and near_roots(spark, texts) == want


@pytest.mark.parametrize("most", [3, 40])
def test_links_do_not_depend_on_group_size(spark, most):
    """A passage that all texts begin with makes the shared hashes' groups large; they are cut into chunks that all meet."""
    texts = edited_texts(seed=9, groups=25) + [" ".join(["same few words come first", *t.split()[:9]]) for t in edited_texts(seed=10, groups=10)]
    want = exact_components(texts)
    assert 25 < len(set(want)) < len(texts) - 20
    assert near_roots(spark, texts, most=most) == want
