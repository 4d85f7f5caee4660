"""Secret scans over an incremental blob ledger.

Every version of a path is addressed by its content's SHA-256. A ledger row is a (blob, rule version) pair with the
spans that the rules found. Only pairs that the ledger lacks are scanned, each distinct blob once; findings are then
joined back to every path and version that has the blob, so copies cost a hash and no scan.

Spans are code point offsets, the end exclusive. A rule's matches are its leftmost, non-overlapping ones; offsets come
from the lengths of the gaps and matches that one pass of the regular expression returns alternately. Matches that are
too short are dropped, as passed over text.

Nulls: a null text is an empty one; null paths are kept. Repeated rows each get their findings. An empty table gives an
empty result. Columns of other names are ignored; those that are asked for come in one struct, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut

RULE_VERSION = 1

# Published credential formats. Kind, cheap test, pattern, condition on the match ($m) or its value ($v).
_ASSIGN = r"((?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)"
RULES = [
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", _ASSIGN, 6),
    ("access", r"AKIA[A-Z0-9]{16}", r"()(AKIA[A-Z0-9]{16,}+)", 0),
    ("hex", r"[0-9a-f]{24}", r"()([0-9a-f]{24,}+)", 0),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"()(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36}", r"()(gh[pousr]_[A-Za-z0-9]{36,}+)", 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10}", r"()(xox[abprs]-[A-Za-z0-9-]{10,}+)", 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8}", r"()(eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]*+)", 0),
]
BASE = ("assign", "access", "hex")
SPANS = "array<struct<start:int,place:int,kind:string,end:int>>"


def _parts(text: Column, place: int, kind: str, test: str, pattern: str, least: int) -> Column:
    """Array of (place, kind, least, i, gap, head, value): lengths of one rule's matches and of the gaps before them, in order."""
    step = F.lit(rf"(?s)(.*?)(?:{pattern}|\z)")
    gaps, heads, values = (F.regexp_extract_all(text, step, F.lit(k)) for k in (1, 2, 3))

    def part(x, i):
        sizes = [F.length(x[c]).alias(n) for c, n in (("g", "gap"), ("h", "head"), ("v", "value"))]
        return F.struct(F.lit(place).alias("place"), F.lit(kind).alias("kind"), F.lit(max(1, least)).alias("least"), i.alias("i"), *sizes)

    parts = F.transform(F.arrays_zip(gaps.alias("g"), heads.alias("h"), values.alias("v")), part)
    none = F.array().cast("array<struct<place:int,kind:string,least:int,i:int,gap:int,head:int,value:int>>")
    return F.when(text.rlike(test), parts).otherwise(none)


def address(text: Column) -> Column:
    """The SHA-256 of a text, which names its blob."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan(blobs: DataFrame, rules=None, version: int = RULE_VERSION) -> DataFrame:
    """Ledger rows (blob, rule_version, spans) of (blob, text) rows, one a blob.

    Where a match begins is the sum of the gaps and matches before it, over a window by blob and rule, so a text with many
    matches costs no more than a row for each.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    found = F.concat(*(_parts(text, k, *rule) for k, rule in enumerate(rules or RULES)))
    rows = blobs.select("blob", F.explode_outer(found).alias("x")).select("blob", "x.*")
    upto = F.sum(F.col("gap") + F.col("head") + F.col("value")).over(Window.partitionBy("blob", "place").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", upto.cast("int"))
    span = F.struct((F.col("end") - F.col("head") - F.col("value")).alias("start"), "place", "kind", "end")
    spans = F.array_sort(F.collect_list(F.when(F.col("value") >= F.col("least"), span)))
    return rows.groupBy("blob").agg(spans.cast(SPANS).alias("spans")).select("blob", F.lit(version).alias("rule_version"), "spans")


def unseen(versions: DataFrame, ledger: DataFrame | None, version: int = RULE_VERSION, text_col: str = "text") -> DataFrame:
    """Each distinct blob that the ledger has not seen under this rule version, once, with its text."""
    rows = versions.select(address(F.col(text_col)).alias("blob"), F.col(text_col).alias("_text"))
    if ledger is not None:
        rows = rows.join(ledger.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    return rows.groupBy("blob").agg(F.any_value("_text").alias("_text"))


def update(versions: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules=None, version: int = RULE_VERSION) -> DataFrame:
    """The ledger with what is new in ``versions``: only unseen (blob, rule version) pairs are scanned."""
    new = scan(unseen(versions, ledger, version, text_col), rules, version)
    return new if ledger is None else ledger.select("blob", "rule_version", "spans").unionByName(new)


def findings(versions: DataFrame, ledger: DataFrame, keys: list[str], text_col: str = "text", version: int = RULE_VERSION) -> DataFrame:
    """(path, blob, spans): ``keys`` (path, version ...) of every row as a struct, with its blob and the blob's spans."""
    rows = versions.select(F.struct(*keys).alias("path"), address(F.col(text_col)).alias("blob"))
    known = ledger.where(F.col("rule_version") == version).select("blob", "spans")
    return rows.join(known, "blob", "left").select("path", "blob", "spans")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def digest(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """The findings of every document, from the ledger, as counts and joined spans."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [_count(k).alias(f"n_{k}") for k in BASE]
    own = ledger.where(F.col("rule_version") == RULE_VERSION)
    own = own.select("blob", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
    rows = docs.select("doc_id", address(F.col("text")).alias("blob"))
    return rows.join(own, "blob").select("doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans")


def query(spark, sf_dir, ledger: DataFrame | None = None):
    """The findings in all documents; a stored ``ledger`` saves the scan of all texts that it has."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(docs, cut(update(docs, ledger), "secrets-ledger"))
