import random
from collections import Counter

from helpers import clashing, docs, store

from tessella.llm import decontaminate as dc
from tessella.llm.common import WORD, ascii_lower


def bag(words):
    n = min(5, len(words))
    return Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))


def brute(text, items):
    """Items with a window of their size that is 0.8 similar, over all windows."""
    words, out = WORD.findall(ascii_lower(text or "")), {}
    for item, body in items:
        want = WORD.findall(ascii_lower(body or ""))
        if not want or not words:
            continue
        size = min(len(want), len(words))
        s = max(dc.similarity(bag(words[k : k + size]), bag(want)) for k in range(len(words) - size + 1))
        if s >= 0.8:
            out[item] = round(s, 9)
    return out


def test_planted_passages_against_brute_force(spark, tmp_path):
    r = random.Random(5)
    vocab = ["".join(r.choices("abcdefg", k=r.randint(1, 5))) for _ in range(200)]
    items = [(k, " ".join(r.choices(vocab, k=r.randint(12, 60)))) for k in range(30)] + [(90, "one two three"), (91, ""), (92, None), (93, "b " * 30)]
    rows = []
    for k in range(160):
        words = r.choices(vocab, k=r.randint(0, 120))
        if k % 2:
            passage = r.choice(items)[1] or ""
            passage = passage.upper().split()
            for _ in range(k % 5 - 1):  # edits
                passage[r.randrange(len(passage) or 1) :][:1] = [r.choice(vocab)]
                if passage:
                    passage[r.choice([0, -1, r.randrange(len(passage))])] = r.choice(vocab)
            at = r.randint(0, len(words))
            words[at:at] = passage
        rows.append((k, r.choice([" ", "\n", "\t "]).join(words)))
    sf = store(spark, tmp_path, "documents", docs(spark, rows))
    store(spark, tmp_path, "benchmark", spark.createDataFrame(items, "item_id long, text string"))
    got = {}
    for x in dc.query(spark, sf).collect():
        got.setdefault(x.doc_id, {})[x.item_id] = round(x.similarity, 9)
    want = {k: w for k, t in rows if (w := brute(t, items))}
    assert got == want and len(want) > 30
    kept = dc.stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert {x.doc_id for x in kept.collect()} == {k for k, _ in rows} - set(want)


def test_stretches_and_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dc, "STRETCH", 16)
    monkeypatch.setattr(dc, "BLOCK", 40)
    item = " ".join(f"w{k}" for k in range(20))
    text = " ".join(["x"] * 9 + item.split() + ["y"] * 40)
    assert [h[1:] for h in dc.Index([(1, item)]).find(text)] == [(1.0, 9, 20)]
    sf = store(spark, tmp_path, "documents", docs(spark, [(1, text), (None, item), (3, None), (4, ""), (1, text)]))
    bench = spark.createDataFrame([(k, item if k == 4 else f"other item number {k} of the list here") for k in range(6)], "item_id long, text string")
    store(spark, tmp_path, "benchmark", bench)
    assert sorted((x.doc_id or 0, x.item_id) for x in dc.query(spark, sf).collect()) == [(0, 4), (1, 4), (1, 4)]
    assert dc.clean(docs(spark, []), bench).count() == 0
    assert dc.leaks(docs(spark, [(1, text)]), bench.limit(0)).count() == 0


def test_results_do_not_depend_on_stretches(spark, monkeypatch):
    """Passages at every place around a stretch's end, whole and cut off at the text's end, against all windows."""
    r = random.Random(8)
    item = " ".join(f"i{k}" for k in range(50))
    index_items = [(1, item), (2, "a b c d e f g")]
    monkeypatch.setattr(dc, "STRETCH", 60)
    index = dc.Index(index_items)
    for before in [0, 1, 9, 10, 11, 12, 35, 58, 59, 60, 61, 62, 69, 70, 71, 118, 119, 120, 121, 122]:
        for kept in (50, 45, 42, 38):
            text = " ".join([*(f"x{r.randrange(900)}" for _ in range(before)), *item.split()[:kept]])
            assert {index_items[k][0]: round(s, 9) for k, s, _, _ in index.find(text)} == brute(text, index_items), (before, kept)


def test_a_cut_off_passage_in_a_long_text():
    """The same at the real stretch: what lies at the end counts as it does anywhere else."""
    item = " ".join(f"i{k}" for k in range(50))
    index, found = dc.Index([(1, item)]), set()
    for n in (1_000, dc.STRETCH - 1, dc.STRETCH + 42, dc.STRETCH + 100):
        found.add(bool(index.find(" ".join([*(f"x{k}" for k in range(n - 42)), *item.split()[:42]]))))
        assert index.find(" ".join([*(f"x{k}" for k in range(n - 50)), item]))[0][1:] == (1.0, n - 50, 50)
    assert found == {False}


def test_ids_stay_exact_and_columns_may_clash(spark):
    big = 9007199254740993
    text = "one two three four five six seven eight"
    frame = clashing(docs(spark, [(big, text), (None, text), (big + 1, "other")]), "doc", "item", "similarity")
    bench = clashing(spark.createDataFrame([(big, text), (None, "else entirely it is not there at all")], "item_id long, text string"), "id", "doc")
    assert {(x.doc_id, x.item_id) for x in dc.leaks(frame, bench).collect()} == {(big, big), (None, big)}
    kept = dc.clean(frame, bench)
    assert kept.columns == frame.columns and [x.doc_id for x in kept.collect()] == [big + 1]
    small = bench.select(bench.item_id.cast("string").alias("item_id"), "text")
    assert {x.item_id for x in dc.leaks(frame, small).collect()} == {str(big)}
