from collections import Counter

import corpus_pipeline
import duckdb
import pyarrow as pa
from helpers import clashing, docs, store
from pyspark.sql import functions as F
from test_decontaminate import bag
from test_decontaminate import brute as brute_leaks
from test_quality import brute_base, brute_distance, brute_references
from test_simhash import exact_components

from tessella.llm import decontaminate, lines, mixing, quality, simhash
from tessella.llm.common import WORD, ascii_lower


def test_every_stage_does_its_work(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, d), "t")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[3] < counts[2] and counts[4] < counts[3] and counts[-1] > 500
    assert simhash.near_clusters(docs).groupBy("root").count().where("count > 1").isEmpty()
    assert decontaminate.leaks(docs, spark.read.parquet(f"{d}/benchmark.parquet")).isEmpty()
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert mixed.where(F.col("copy") > 2).isEmpty() and mixed.select("doc_id").distinct().count() > 300
    labels = spark.read.parquet(f"{d}/labels.parquet")
    good = labels.where("quality = 1").join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id").where(F.size(F.split("text", r"\s+")) > 50)
    kept = corpus_pipeline.STAGES[0][1](spark, good, d)
    assert kept.count() > 0.97 * good.count()


def test_run_on_hard_rows(spark, tmp_path):
    """Empty, null, repeated and very long texts, null ids and clashing columns, through all stages; and an empty table."""
    text = "The cat sat on the mat, and the dog lay by the door of the house in the sun all day, and then the night came over them both."
    rows = [(1, text), (1, text), (2, text), (None, text.replace("cat", "cow")), (None, None), (3, ""), (4, None), (5, (text + "\n") * 3000), (6, "short")]
    frame = clashing(docs(spark, rows), "_key", "copy", "doc", "kept", "id", "th", "rated", "node")
    store(spark, tmp_path, "benchmark", spark.createDataFrame([(1, "an item that no document holds, whatever it says about it all")], "item_id long, text string"))
    sf = store(spark, tmp_path, "documents", frame)
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*frame.columns, "copy_"] and {r.copy for r in out.collect()} == {"own"}
    assert {r.doc_id for r in out.collect()} <= {1, 2, None}
    store(spark, tmp_path, "documents", frame.limit(0))
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_run_applies_all_stages(spark):
    d = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, d)
    ids = {r.doc_id for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id").collect()}
    kept = [r.doc_id for r in out.collect()]
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"] and set(kept) < ids and max(map(kept.count, set(kept))) <= 2


def sql(rows, oracle, columns):
    """Rows of an operator's SQL over documents given as tuples."""
    fields = ["doc_id", "text", "lang", "source", "n_chars"]
    con = duckdb.connect()
    con.register("documents", pa.table({name: [r[k] for r in rows] for k, name in enumerate(fields)}))
    return con.sql(f"SELECT {columns} FROM ({oracle})").fetchall()


def plain_quality(rows, items):
    refs = brute_references([(r[0], r[1], r[2]) for r in rows])

    def stays(text, lang):
        if brute_base(text or "")[-1]:
            return False
        low = [ascii_lower(w) for w in WORD.findall(text)]
        kinds, top, total, bare = refs.get(lang) or refs[quality.ALL]
        own, n = Counter(quality.TABLE[min(ord(c), 65535)] for c in text), Counter(low)
        common, odd = [n[t] for t in top], sum(not any(c.isalnum() for c in w) for w in low)
        by_class = brute_distance([own[c] for c in range(7)], [kinds[c] for c in range(7)])
        by_word = brute_distance([*common, len(low) - sum(common) - odd, odd], [*top.values(), total - sum(top.values()) - bare, bare])
        return by_class <= 0.20 + 0.9 / len(low) ** 0.5 and by_word <= 0.38 + 1.0 / len(low) ** 0.5

    return [r for r in rows if stays(r[1], r[2])]


def plain_lines(rows, items):
    new = {k: (n, text) for k, n, text in sql(rows, lines.ORACLE, "doc_id, n_dropped, text")}
    out = [r if not new[r[0]][0] else (r[0], new[r[0]][1], *r[2:4], len(new[r[0]][1])) for r in rows]
    return [r for r in out if not new[r[0]][0] or WORD.search(r[1])]


def plain_near(rows, items):
    rows = sorted(rows)
    roots = exact_components([r[1] for r in rows])
    return [r for k, r in enumerate(rows) if roots[k] == k]  # roots are least places, and so least ids


def plain_clean(rows, items):
    """A window is 0.8 similar to an item only if the whole text has 0.8 of the item's shingles."""
    out = []
    for r in rows:
        words = WORD.findall(ascii_lower(r[1]))
        own = bag(words)

        def may(body):
            want = WORD.findall(ascii_lower(body or ""))
            return len(words) < len(want) or sum((bag(want) & own).values()) >= 0.8 * bag(want).total() - 1e-9

        if not brute_leaks(r[1], [(k, body) for k, body in items if may(body)]):
            out.append(r)
    return out


def plain_mix(rows, items):
    taken = {k: n // size if size else 0 for k, size, n in sql(rows, mixing.ORACLE, "doc_id, size, taken")}
    return [(*r, c) for r in rows for c in range(1, taken[r[0]] + 1)]


def test_every_stage_and_the_run_against_plain_versions(spark, tmp_path):
    """Which documents are left after each stage, with which texts; and what a whole run returns."""
    d = "/root/testdata/sf0.01"
    raw = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").where("doc_id < 600").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    # near copies, leaking texts and shared long lines, as few of them are among so few documents
    good = [r for r in raw if len(WORD.findall(r[1] or "")) > 150][:40]
    line = "This very line of more than ten words stands in several texts of this small corpus."
    for k, (_, text, lang, source, _n) in enumerate(good):
        words = text.split(" ")
        made = [" ".join([*words[: 3 + k], "changed", *words[4 + k :]]), f"{text}\n{line}", f"{text}\n{items[k % len(items)][1]}"][k % 3]
        raw.append((10_000 + k, made, lang, source, len(made)))
    raw = [(*r[:4], len(r[1] or "")) for r in raw]
    frame = docs(spark, [r[:4] for r in raw]).repartition(3)
    sf = store(spark, tmp_path, "documents", frame)
    store(spark, tmp_path, "benchmark", spark.read.parquet(f"{d}/benchmark.parquet"))
    want, sizes = raw, [len(raw)]
    now = spark.read.parquet(f"{sf}/documents.parquet")
    plain = [plain_quality, plain_lines, plain_near, plain_clean, plain_mix]
    for (name, stage), same in zip(corpus_pipeline.STAGES, plain, strict=True):
        now = corpus_pipeline.cut(stage(spark, now, sf), "t")
        want = sorted(same(want, items))
        assert sorted(tuple(r) for r in now.collect()) == want, name
        sizes.append(len(want))
    assert sizes[1] < sizes[0] and sizes[3] < sizes[2] and sizes[4] < sizes[3] and len(want) > 200
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == want
