import duckdb
from helpers import clashing, docs, store

from tessella.llm import mixing


def oracle(path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    return sorted(con.sql(mixing.ORACLE).fetchall(), key=str)


def result(spark, path):
    return sorted((tuple(r) for r in mixing.query(spark, path).collect()), key=str)


def test_against_sql_with_a_hot_source(spark, tmp_path):
    rows = [(k, "w " * (k * 7919 % 97), "en", "hot" if k % 3 else f"s{k % 11}") for k in range(900)]
    rows += [(None, "a b", "en", None), (5, "x", "en", "tiny"), (5, "x", "en", "tiny"), (6, None, "en", "empty"), (7, "y " * 5000, None, "hot")]
    path = store(spark, tmp_path, "documents", docs(spark, rows))
    got = result(spark, path)
    assert got == oracle(path) == result(spark, path)
    by = {}
    for (_, size, whole, target, taken) in got:
        assert taken in (0, size, 2 * size)
        by.setdefault((whole, target), []).append(taken)
    for (whole, target), taken in by.items():
        assert target <= 2 * whole + 1e-6 and abs(sum(taken) - target) <= 5000
    sources = mixing.mix(spark.read.parquet(f"{path}/documents.parquet")).select("source", "source_size", "target").distinct().collect()
    assert abs(sum(s.target for s in sources) - 1.5 * sum(s.source_size for s in sources)) < 1e-3


def test_edges(spark, tmp_path):
    assert mixing.query(spark, store(spark, tmp_path / "a", "documents", docs(spark, []))).count() == 0
    path = store(spark, tmp_path / "b", "documents", docs(spark, [(1, None), (2, "")]))
    assert [(r.size, r.taken) for r in mixing.query(spark, path).collect()] == [(0, 0), (0, 0)]


def test_stage_repeats_rows(spark):
    frame = docs(spark, [(k, "w " * 20, "en", f"s{k % 3}") for k in range(60)]).withColumnsRenamed({"lang": "size", "n_chars": "bucket"})
    out = mixing.stage(spark, frame, None)
    assert out.columns == [*frame.columns, "copy"] and out.count() == 90
    frame = clashing(frame, "copy", "kept", "u", "tie", "_id")
    out = mixing.stage(spark, frame, None)
    assert out.columns == [*frame.columns, "copy_"] and {r.copy for r in out.select("copy").collect()} == {"own"} and out.count() == 90


def test_many_equal_rows(spark, monkeypatch):
    """Rows that share id, size and so their rank: as many are taken as by the order of single rows, in whatever parts."""
    monkeypatch.setattr(mixing, "PARTS", 7)
    rows = [(None, "w w w", "en", "a")] * 400 + [(k, "w " * 5, "en", "b") for k in range(50)] + [(1, "v", "en", "b")] * 300
    got = mixing.mix(docs(spark, rows)).select("source", "size", "target", "taken").collect()
    assert len(got) == len(rows)
    for s in "ab":
        mine = [r for r in got if r.source == s]
        assert all(r.taken in (0, r.size, 2 * r.size) for r in mine) and abs(sum(r.taken for r in mine) - mine[0].target) <= 5
