import hashlib
import re

from helpers import clashing, docs, store
from pyspark.sql import functions as F

from tessella.llm import secrets

ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)


def brute(text):
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
    return *(sum(s[2] == k for s in spans) for k in secrets.BASE), hashlib.sha256(joined.encode()).hexdigest()


def test_matches_brute_force_on_a_whole_table(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.query(spark, d).collect()}
    texts = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r.doc_id: brute(r.text or "") for r in texts}
    assert sum(x[0] for x in got.values()) > 0


def test_edges(spark, tmp_path):
    hard = [
        "secret: token: abcdefghij", "token=token=abcdefgh", "PASSWORD = 'abc'", "é😀 api_key=\"abcdef\" x",
        "AKIA" + "A" * 16, "AKIA" + "A" * 15, "f" * 23, "f" * 24 + "g" + "0" * 30, "x password:" + "a" * 5000,
        "", None, "ghp_" + "Z" * 36, "-----BEGIN RSA PRIVATE KEY-----", "token\n=abcdef", "ſecret=abcdefg", "secret=abcdefg" * 3,
    ]
    sf = store(spark, tmp_path, "documents", docs(spark, [(k, t) for k, t in enumerate(hard)] + [(None, hard[0]), (0, hard[0])]))
    rows = secrets.query(spark, sf).collect()
    assert len(rows) == len(hard) + 2
    for r in rows:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == brute(hard[r.doc_id or 0] or ""), r
    assert next(r.spans for r in rows if r.doc_id == 11) == "github:0:40"
    empty = store(spark, tmp_path / "e", "documents", docs(spark, []))
    assert secrets.query(spark, empty).count() == 0


def test_ledger_scans_only_unseen_pairs(spark):
    first = docs(spark, [(1, "token=abcdefgh"), (2, "token=abcdefgh"), (3, "plain")])
    ledger = secrets.update(first)
    assert ledger.count() == 2
    later = docs(spark, [(1, "token=abcdefgh"), (1, "new secret=abcdefgh")])
    assert secrets.unseen(later, ledger).count() == 1
    assert secrets.unseen(later, ledger, version=2).count() == 2
    whole = secrets.update(later, ledger)
    assert whole.count() == 3
    found = {(r.path.doc_id, len(r.spans)) for r in secrets.findings(first.unionByName(later), whole, ["doc_id"]).collect()}
    assert found == {(1, 1), (2, 1), (3, 0)}
    own = clashing(later, "blob", "spans", "_text", "kind")
    assert {r.path.blob for r in secrets.findings(own, secrets.update(own, ledger), ["doc_id", "blob", "spans"]).collect()} == {"own"}


def test_query_on_a_stored_ledger(spark, tmp_path):
    sf = store(spark, tmp_path, "documents", docs(spark, [(1, "token=abcdefgh"), (2, "plain")]))
    planted = secrets.update(docs(spark, [(9, "plain")])).withColumn("spans", F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("place"), F.lit("assign").alias("kind"), F.lit(5).alias("end"))))
    got = {r.doc_id: r.spans for r in secrets.query(spark, sf, ledger=planted).collect()}
    assert got == {1: "assign:0:14", 2: "assign:0:5"}  # what the ledger has is not scanned again


def test_further_kinds(spark):
    texts = ["x -----BEGIN RSA PRIVATE KEY----- y -----BEGIN PRIVATE KEY-----", "é xoxb-" + "1" * 12 + " ghs_" + "Z" * 40, "eyJabcdefgh.abcdefgh.sig eyJabc.x.y", "ghp_short xoxb-1 eyJ"]
    got = {r._text: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.scan(spark.createDataFrame([(t, t) for t in texts], "blob string, _text string")).withColumn("_text", F.col("blob")).collect()}
    assert got[texts[0]] == [("private_key", 2, 33), ("private_key", 36, 63)]
    assert got[texts[1]] == [("slack", 2, 19), ("github", 20, 64)]
    assert got[texts[2]] == [("jwt", 0, 24)] and got[texts[3]] == []


def test_a_text_with_many_matches(spark):
    text = " ".join(f"token=abcdef{k:06d}" for k in range(60_000))
    (row,) = secrets.scan(spark.createDataFrame([("b", text)], "blob string, _text string")).collect()
    assert len(row.spans) == 60_000 and (row.spans[-1].start, row.spans[-1].end) == (59_999 * 19, len(text))
