"""Mixing sources to target weights by Pareto order sampling.

Word budgets are dealt to sources by weight with caps (water filling), and inside a source to length classes: a
document's expected copies are proportional to the bit length of its size, at most ``cap``. Whole expected copies are
certain. The fractional rest is the inclusion probability p of one more copy: documents are ranked by
[u/(1-u)] / [p/(1-p)], u being a hash of the document, and taken in that order until the source's words are reached.

The ranking never sorts a source: ranks are counted in ``BUCKETS`` buckets (partial sums), and only the one bucket
that holds the cut is ordered, about 1/BUCKETS of a source. There, rows of equal rank, id and size are counted as one;
of those that the cut divides, as many as are due are found by counts over ``PARTS`` parts, so that copies without
number never meet in one task.

Nulls: a null text has size 0 and is taken 0 times over; a null source is a source of its own, last in order; null ids
hash as empty text. Equal rows are interchangeable. An empty table gives an empty result. Columns that are asked
for besides are carried inside one struct, so none can clash; the stage adds ``copy``, with as many underscores behind
it as it takes to differ from the input's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, n_words

WEIGHTS, SHARE, CAP, BUCKETS, PARTS = (3, 1, 2), 1.5, 2, 1 << 16, 1024


def water_fill(df: DataFrame, group: list[str], weight: Column, most: Column, total: Column) -> DataFrame:
    """Share ``total`` of each group by weight, nothing above ``most``; the excess goes to the others by weight.

    Adds ``level``: a row gets level * weight, or ``most`` where ``full``. One row per source or length class.
    """
    by = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    df = df.withColumns({"_w": weight, "_most": most, "_total": total})
    df = df.where("_w > 0")
    ordered = by.orderBy(F.col("_most") / F.col("_w"), F.col("_key"))
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("_w").over(by) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    df = df.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_most").over(before), F.lit(0))) / rest)
    df = df.withColumn("full", F.col("_most") / F.col("_w") <= F.col("_level"))
    df = df.withColumn("level", F.min_by(F.when(~F.col("full"), F.col("_level")), F.when(~F.col("full"), F.col("_most") / F.col("_w"))).over(by))
    return df.drop("_w", "_most", "_total", "_level")


def plan_copies(sized: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """Per source and length class: target, certain copies, p and the words that p shares out in the source."""
    classes = sized.groupBy("source", "bits").agg(F.sum("size").alias("words"))
    sources = classes.groupBy("source").agg(F.sum("words").alias("source_size")).withColumn("_one", F.lit(0))
    place = F.row_number().over(Window.partitionBy("_one").orderBy(F.col("source").isNull(), "source"))
    sources = sources.withColumn("_key", place)
    total = F.sum("source_size").over(Window.partitionBy("_one")) * F.lit(float(share))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_key") - 1) % len(weights) + 1)
    most = F.col("source_size") * cap
    sources = sources.withColumns({"_weight": weight, "_cap": most})
    sources = water_fill(sources, [], F.col("_weight"), F.col("_cap"), total)
    sources = sources.withColumn("target", F.when(F.col("full"), F.col("_cap").cast("double")).otherwise(F.col("level") * F.col("_weight")))
    sources = sources.select(F.col("source").alias("_s"), "source_size", "target")

    classes = classes.join(sources, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_key", F.col("bits"))
    some = water_fill(classes.where("words > 0"), ["source"], F.col("words") * F.col("bits"), F.col("words") * cap, F.col("target"))
    copies = F.when(F.col("full"), F.lit(float(cap))).otherwise(F.col("level") * F.col("bits"))
    none = classes.where("words = 0").withColumns({"full": F.lit(False), "level": F.lit(0.0)})
    both = some.unionByName(none).withColumn("_copies", copies)
    both = both.withColumns({"certain": F.floor("_copies").cast("long"), "p": F.col("_copies") - F.floor("_copies")})
    rest = F.col("target") - F.sum(F.col("certain") * F.col("words")).over(Window.partitionBy("source"))
    return both.withColumn("rest", rest).select("source", "bits", "source_size", "target", "certain", "p", "rest")


def _divided(edge: DataFrame) -> DataFrame:
    """``extra`` (0 or 1) for the rows of the buckets that hold the cuts.

    Rows come in order of rank, id and size; one is taken if the words before it and half its own are within the rest.
    """
    keys = ["source", "rank", "_id", "size"]
    groups = edge.groupBy(*keys, "rest", "cut_from").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("source").orderBy("rank", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("cut_from") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(order), F.lit(0))
    room = F.floor((F.col("rest") - before - F.col("size") / 2) / F.greatest("size", F.lit(1))) + 1  # how many of n equal rows fit
    room = F.when(F.col("size") > 0, room).when(before <= F.col("rest"), F.col("n")).otherwise(0)
    groups = groups.withColumn("due", F.least(F.greatest(room, F.lit(0)), F.col("n")).cast("long"))
    groups = cut(groups.select(*(F.col(k).alias(f"g_{k}") for k in keys), "n", "due"), "mix-edges")
    same = [F.col(k).eqNullSafe(F.col(f"g_{k}")) for k in keys]
    rows = edge.join(groups, same[0] & same[1] & same[2] & same[3]).drop(*(f"g_{k}" for k in keys))
    plain = rows.where("due = 0 or due = n").withColumn("extra", (F.col("due") > 0).cast("int"))
    split = rows.where("due > 0 and due < n").withColumn("part", F.pmod(F.xxhash64("tie"), F.lit(PARTS)))
    if groups.where("due > 0 and due < n").isEmpty():
        return plain.drop("n", "due")
    upto = F.sum("own").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    parts = split.groupBy("source", "part").agg(F.count(F.lit(1)).alias("own")).withColumn("upto", upto)
    parts = cut(parts.select(F.col("source").alias("_s"), F.col("part").alias("_p"), "own", "upto"), "mix-parts")
    split = split.join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p"))).drop("_s", "_p")
    place = F.row_number().over(Window.partitionBy("source", "part").orderBy("tie"))
    split = split.withColumn("extra", (F.col("upto") - F.col("own") + place <= F.col("due")).cast("int"))
    return plain.drop("n", "due").unionByName(split.drop("n", "due", "part", "own", "upto"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=SHARE, cap=CAP, keep=()) -> DataFrame:
    """id, size, source_size, target, copies and taken (words) for every document; ``keep`` names more columns, in the struct ``kept``."""
    size = n_words(F.col(text_col))
    digest = F.md5(F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string")))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    kept = F.struct(*keep) if keep else F.lit(0)
    sized = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), size.alias("size"), kept.alias("kept"))
    sized = sized.withColumns({"bits": F.length(F.bin("size")).cast("long"), "u": u, "tie": F.monotonically_increasing_id()})
    sized = cut(sized, "mix-sized")
    plan = cut(plan_copies(sized, weights, share, cap), "mix-plan").withColumnsRenamed({"source": "_s", "bits": "_b"})
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bits") == F.col("_b"))).drop("_s", "_b")
    rank = F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p")))
    rows = rows.withColumn("rank", rank).withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS).cast("int"))

    sums = rows.where("rank is not null").groupBy("source", "bucket", "rest").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    sums = sums.withColumn("_upto", upto).where(F.col("_upto") > F.col("rest"))
    ends = sums.groupBy("source").agg(F.min("bucket").alias("cut_at"), F.min_by(F.col("_upto") - F.col("words"), "bucket").alias("cut_from"))
    ends = cut(ends, "mix-cuts").withColumnRenamed("source", "_s")
    rows = rows.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")

    at_cut = F.coalesce(F.col("bucket") == F.col("cut_at"), F.lit(False))
    plain = rows.where(~at_cut).withColumn("extra", F.when(F.col("rank").isNotNull() & (F.col("cut_at").isNull() | (F.col("bucket") < F.col("cut_at"))), 1).otherwise(0))
    out = plain.unionByName(_divided(rows.where(at_cut))).withColumn("copies", F.col("certain") + F.col("extra"))
    last = ["kept"] if keep else []
    return out.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *last)


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
ranked AS (
  SELECT *, length(bin(size)) AS bits,
    (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR)), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM sized),
classes AS (SELECT source, bits, CAST(sum(size) AS BIGINT) AS words FROM ranked GROUP BY ALL),
src AS (
  SELECT *, [3, 1, 2][(place - 1) % 3 + 1] AS w, source_size * 2 AS most
  FROM (SELECT source, CAST(sum(words) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM classes GROUP BY source)),
src2 AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER o, 0)::DOUBLE)
    / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS lv
  FROM src WINDOW o AS (ORDER BY most::DOUBLE / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
src3 AS (
  SELECT *, most::DOUBLE / w <= lv AS full_, min_by(CASE WHEN most::DOUBLE / w <= lv THEN NULL ELSE lv END, CASE WHEN most::DOUBLE / w <= lv THEN NULL ELSE most::DOUBLE / w END) OVER () AS level FROM src2),
targets AS (SELECT source, source_size, CASE WHEN full_ THEN most::DOUBLE ELSE level * w END AS target FROM src3),
c1 AS (SELECT c.*, t.source_size, t.target FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source),
c2 AS (
  SELECT *, (target - coalesce(sum(words * 2) OVER o, 0)::DOUBLE)
    / (sum(words * bits) OVER (PARTITION BY source) - coalesce(sum(words * bits) OVER o, 0))::DOUBLE AS lv
  FROM c1 WHERE words > 0
  WINDOW o AS (PARTITION BY source ORDER BY (words * 2)::DOUBLE / (words * bits), bits ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c3 AS (
  SELECT *, (words * 2)::DOUBLE / (words * bits) <= lv AS full_,
    min_by(CASE WHEN (words * 2)::DOUBLE / (words * bits) <= lv THEN NULL ELSE lv END, CASE WHEN (words * 2)::DOUBLE / (words * bits) <= lv THEN NULL ELSE (words * 2)::DOUBLE / (words * bits) END) OVER (PARTITION BY source) AS level
  FROM c2),
c4 AS (
  SELECT source, bits, words, source_size, target, CASE WHEN full_ THEN 2.0::DOUBLE ELSE level * bits END AS e FROM c3
  UNION ALL SELECT source, bits, words, source_size, target, 0.0::DOUBLE FROM c1 WHERE words = 0),
plan AS (
  SELECT *, CAST(floor(e) AS BIGINT) AS certain, e - floor(e) AS p, target - (sum(CAST(floor(e) AS BIGINT) * words) OVER (PARTITION BY source))::DOUBLE AS rest FROM c4),
r AS (
  SELECT k.doc_id, k.source, k.size, l.source_size, l.target, l.certain, l.rest,
    CASE WHEN l.p > 0 THEN (k.u / (1 - k.u)) * ((1 - l.p) / l.p) END AS rnk
  FROM ranked k JOIN plan l ON k.source IS NOT DISTINCT FROM l.source AND k.bits = l.bits),
run AS (
  SELECT *, coalesce(sum(CASE WHEN rnk IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY rnk NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before FROM r)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST(size * (certain + CASE WHEN rnk IS NOT NULL AND before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run
"""


def stage(spark, docs, sf_dir):
    """The mix itself: every document as often as it is taken, numbered by ``copy`` from 1."""
    columns, name = docs.columns, "copy"
    while name in columns:
        name += "_"
    rows = mix(docs, keep=columns).where("copies > 0")
    rows = rows.select("kept", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("number"))
    return rows.select(*(F.col("kept")[c].alias(c) for c in columns), F.col("number").alias(name))
