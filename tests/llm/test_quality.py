import math
from collections import Counter

import numpy as np
from helpers import clashing, docs, store
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import quality
from tessella.llm.common import WORD


def brute_base(text):
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    n = Counter(windows)
    covered = {k + i for k, w in enumerate(windows) if n[w] > 1 for i in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(words), sum(len(w) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "A", "é", "#", "x|", "\n", " ", "a b a b a b a b a b"]), max_size=60).map(" ".join))
def test_base_against_brute_force(text):
    assert quality.base(text, WORD.findall(text)) == brute_base(text)


def test_distance():
    p, q = np.array([1.0, 0, 1]), np.array([0, 2.0, 2])
    m = np.array([0.25, 0.25, 0.5])
    want = math.sqrt((0.5 * math.log2(2) + 0.5 * math.log2(1)) / 2 + (0.5 * math.log2(2) + 0.5 * math.log2(1)) / 2)
    assert quality.js_distance(p, q) == want and (p / 2 + q / 4 == 2 * m).all()
    assert quality.js_distance(p, p) == 0 and quality.js_distance(np.array([1.0, 0]), np.array([0, 3.0])) == 1


def test_whole_table_and_labels(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in quality.query(spark, d).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert set(rows) == set(texts)
    for k, t in texts.items():
        r = rows[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(t)
        assert not (r.base_failed and r.kept)
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    good = [rows[x.doc_id].kept for x in labels if x.quality == 1 and not rows[x.doc_id].base_failed]
    bad = [rows[x.doc_id].kept for x in labels if x.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_references_are_exact_sums(spark):
    text = "The cat sat on the mat and the dog lay by the door of the house in the sun all day"
    frame = docs(spark, [(1, text, "en"), (2, text.upper(), "en"), (3, "short", "en"), (4, text + " | | 12", None)])
    refs = quality.references(frame)
    assert refs["en"]["total"] == 42 and refs["en"]["words"]["the"] == 12 and refs["en"]["bare"] == 0
    assert refs[None]["bare"] == 2 and refs[None]["words"]["12"] == 1 and refs[quality.ALL]["total"] == 66
    assert refs["en"]["classes"].sum() == 2 * len(text)


def test_edges(spark, tmp_path):
    frame = docs(spark, [(None, None, None), (1, ""), (2, "w " * 60000), (2, "w " * 60000), (3, " ".join(f"word{k}" for k in range(30)), "xx")])
    sf = store(spark, tmp_path, "documents", frame)
    rows = quality.query(spark, sf).collect()
    assert len(rows) == 5 and [r.n_words for r in rows if r.doc_id == 2] == [60000, 60000]
    assert quality.query(spark, store(spark, tmp_path / "e", "documents", docs(spark, []))).count() == 0
    clash = clashing(frame.withColumnsRenamed({"source": "kept", "n_chars": "n_words"}), "_rated", "rated", "doc")
    assert quality.stage(spark, clash, None).columns == clash.columns
    assert quality.stage(spark, clash, None).select("rated", "_rated").distinct().count() <= 1


def test_any_character_in_words_and_languages(spark):
    text = "The cat sat on the mat and the dog lay by the door of the house in the sun all day"
    odd = "\x00foo \x00total \x00bare \x00all \x001 " + text
    frame = docs(spark, [(1, text, "en"), (2, odd, "en"), (3, odd, "\x00all"), (4, odd, None), (5, odd, ""), (6, odd, "all")])
    refs = quality.references(frame)
    assert set(refs) == {"en", "\x00all", None, "", "all", quality.ALL}
    assert refs["en"]["words"]["\x00foo"] == 1 and refs["en"]["total"] == 21 + 26 and refs[None] is not refs[""]
    assert quality.stage(spark, frame, None).count() <= 6


def brute_references(rows):
    """By language and over all: class counts, the most frequent words with a letter or digit, all words, tokens without."""
    out = {}
    for _, text, lang in rows:
        words = WORD.findall(text or "")
        if brute_base(text or "")[-1]:
            continue
        for key in (lang, quality.ALL):
            kinds, found = out.setdefault(key, (Counter(), Counter()))
            kinds.update(quality.TABLE[min(ord(c), 65535)] for c in text)
            found.update("".join(c.lower() if c.isascii() else c for c in w) for w in words)
    refs = {}
    for key, (kinds, found) in out.items():
        named = {w: n for w, n in found.items() if any(c.isalnum() for c in w)}
        top = dict(sorted(named.items(), key=lambda x: (-x[1], x[0].encode()))[: quality.COMMON])
        refs[key] = kinds, top, found.total(), found.total() - sum(named.values())
    return refs


def brute_distance(p, q):
    a, b, total = sum(p), sum(q), 0.0
    for x, y in zip(p, q, strict=True):
        x, y = x / a, y / b
        total += (x * math.log2(x / ((x + y) / 2)) if x else 0) / 2 + (y * math.log2(y / ((x + y) / 2)) if y else 0) / 2
    return math.sqrt(max(total, 0.0))


def test_verdicts_of_a_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    refs, got = brute_references(rows), {r.doc_id: r for r in quality.query(spark, d).collect()}
    for k, text, lang in rows:
        words = WORD.findall(text or "")
        if not words:
            continue
        kinds, top, total, bare = refs.get(lang) or refs[quality.ALL]
        own = Counter(quality.TABLE[min(ord(c), 65535)] for c in text)
        by_class = brute_distance([own[c] for c in range(7)], [kinds[c] for c in range(7)])
        low = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
        common, odd = [sum(w == t for w in low) for t in top] if len(low) < 400 else None, sum(not any(c.isalnum() for c in w) for w in low)
        assert math.isclose(got[k].class_distance, by_class, abs_tol=1e-9)
        if common is None:
            n = Counter(low)
            common = [n[t] for t in top]
        by_word = brute_distance([*common, len(words) - sum(common) - odd, odd], [*top.values(), total - sum(top.values()) - bare, bare])
        assert math.isclose(got[k].word_distance, by_word, abs_tol=1e-9)
        near = by_class <= 0.20 + 0.9 / len(words) ** 0.5 and by_word <= 0.38 + 1.0 / len(words) ** 0.5
        assert got[k].kept == (not got[k].base_failed and (near or len(words) < 20))
