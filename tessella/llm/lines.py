"""Line dedup by a log-template tree.

A line's words are lower-cased and words with a digit become the wildcard. The tree has a fixed depth: a line goes
to the leaf of its word count and its ``DEPTH`` leading words. In a leaf, a word at a place that fewer than ``LEAST``
texts share there is a variable field and becomes the wildcard too; what is left is the line's template. Where less
than half of a line's words would stay, or under ``CONSTANT``, the line is its own template.

A template recurs if lines of ``LEAST`` different texts have it; exact copies of a document count once. Lines of
recurring templates are dropped, but for the template's first line (least id, then place), so no content leaves the
corpus altogether. Lines without or with fewer than ``CONSTANT`` words always stay.

A line of ``LONG`` words or more also recurs from two different texts on if it stands there letter by letter (``exact``);
LEAST is for templates and short lines, which may agree by chance.

A word's number of texts is the sum over the distinct lines that have it. Leaves, lines and templates are counted by
hash in pre-aggregated shuffles; only words of leaves that LEAST texts share are looked at.

Lines and templates are told apart by a hash together with their leaf's, documents by their id and a hash of the text.

Nulls: a null text stays null and has no lines; a null id orders last. Repeated rows are treated alike. An empty table
gives an empty result. Columns of any other name are carried inside one struct, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WORD_SQL, cut, discard

LEAST, DEPTH, CONSTANT, SHARE, LONG = 10, 2, 3, 0.5, 10
DIGITS = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def _plain(line: Column) -> Column:
    """The line's words, lower-cased and masked, with single spaces; patterns run only where a cheap test finds cause."""
    low = F.lower(line)
    low = F.when(low.rlike("[0-9]"), F.regexp_replace(low, DIGITS, "<*>")).otherwise(low)
    tidy = F.trim(F.regexp_replace(low, r"[\x20\x09-\x0D]+", " "))
    return F.when(low.rlike(r"[\x09-\x0D]|^\x20|\x20\x20|\x20\z"), tidy).otherwise(low)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, pos, same, plain, n, leaf, lh) of all lines; th hashes the text, same the line, lh its plain words, n counts them."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    rows = rows.select("id", "th", "pos", F.xxhash64("line").alias("same"), _plain(F.col("line")).alias("plain"))
    n = F.when(F.col("plain") == "", 0).otherwise(F.octet_length("plain") - F.octet_length(F.replace("plain", F.lit(" "))) + 1)
    lead = F.substring_index("plain", " ", DEPTH)
    return rows.select("*", n.alias("n"), F.xxhash64(n, lead).alias("leaf"), F.xxhash64("plain").alias("lh"))


def _repeats(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, th, pos) of long lines that two texts or more have, but for each one's first place; and the table it reads."""
    long = lines.where(F.col("n") >= LONG).select("id", "th", "pos", "same", "leaf")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "th", "pos")
    first = long.groupBy("same", "leaf").agg(F.min(place).alias("first"), (F.min("th") != F.max("th")).alias("several"))
    first = cut(first.where("several").drop("several"), "lines-repeated")
    return long.join(first, ["same", "leaf"]).where(place != F.col("first")).select("id", "th", "pos"), first


def dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact: bool = True) -> DataFrame:
    """(id, th, drops): the places of the lines to drop, for every document that has any; a written table."""
    every = _lines(docs, id_col, text_col).drop("plain")
    every = cut(every if exact else every.drop("same"), "lines")
    lines = every.where(F.col("n") >= CONSTANT).drop("same")
    leaves = lines.select("leaf", "th").distinct().groupBy("leaf").count().where(F.col("count") >= LEAST).select("leaf")
    leaves = cut(leaves, "lines-leaves")
    shared = cut(lines.join(leaves, "leaf", "left_semi"), "lines-shared")
    texts = shared.select("leaf", "lh", "th").distinct().groupBy("leaf", "lh").agg(F.count(F.lit(1)).alias("texts"))

    words = _lines(docs, id_col, text_col).select("leaf", "lh", "n", "plain").join(leaves, "leaf", "left_semi")
    words = words.groupBy("leaf", "lh").agg(F.any_value("n").alias("n"), F.split(F.any_value("plain"), " ").alias("tokens"))
    words = cut(words.join(texts, ["leaf", "lh"]), "lines-words")
    each = words.select("leaf", "lh", "n", "texts", F.posexplode("tokens").alias("i", "word"))
    steady = each.groupBy("leaf", "i", "word").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= LEAST)
    steady = steady.select("leaf", "i", "word", F.lit(True).alias("steady"))
    parts = each.where("word <> '<*>'").join(steady, ["leaf", "i", "word"], "left")
    made = parts.groupBy("leaf", "lh", "n").agg(
        F.count("steady").alias("constant"), F.array_sort(F.collect_list(F.when(F.col("steady"), F.struct("i", "word")))).alias("kept")
    )
    general = (F.col("constant") >= CONSTANT) & (F.col("constant") >= F.col("n") * SHARE)
    made = made.select("leaf", "lh", F.when(general, F.xxhash64("leaf", "kept")).otherwise(F.col("lh")).alias("template"))
    made = cut(made, "lines-made")  # a table, so that the join beside it can be broadcast or split where a line is hot

    named = cut(shared.join(made, ["leaf", "lh"]).select("leaf", "template", "id", "th", "pos"), "lines-templates")
    recurring = named.select("leaf", "template", "th").distinct().groupBy("leaf", "template").count().where(F.col("count") >= LEAST).drop("count")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "th", "pos")
    first = cut(named.groupBy("leaf", "template").agg(F.min(place).alias("first")).join(recurring, ["leaf", "template"]), "lines-first")
    rows = named.join(first, ["leaf", "template"]).where(place != F.col("first")).select("id", "th", "pos")
    used = [every, leaves, shared, words, made, named, first]
    if exact:
        repeats, again = _repeats(every)
        rows = rows.unionByName(repeats)
        used.append(again)
    drops = cut(rows.groupBy("id", "th").agg(F.collect_set("pos").alias("drops")), "lines-drops")
    discard(*used)
    return drops


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact: bool = True) -> DataFrame:
    """(doc, n_lines, n_dropped): each row of ``docs`` as a struct, without the dropped lines, and the numbers of its lines and of those dropped."""
    drops = dropped(docs, id_col, text_col, exact).select(F.col("id").alias("k"), F.col("th").alias("h"), "drops")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"))
    rows = rows.join(drops, F.col("id").eqNullSafe(F.col("k")) & (F.col("th") == F.col("h")), "left")
    text = F.col("doc")[text_col]
    rows = rows.select("doc", "drops", F.split(text, "\n", -1).alias("lines"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    kept = F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n")
    new = F.when(F.col("drops").isNull(), text).otherwise(kept)
    n = F.coalesce(F.size("lines"), F.lit(0)).cast("long")
    dropped_ = F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long")
    doc = F.struct(*(new.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns))
    return rows.select(doc.alias("doc"), F.when(n > 0, n).otherwise(F.lit(0)).alias("n_lines"), dropped_.alias("n_dropped"))


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc.doc_id", "n_lines", "n_dropped", "doc.text")


def stage(spark, docs, sf_dir):
    """Documents without recurring lines; one that loses all its words goes. ``n_chars``, if there, is counted anew."""
    rows = dedup(docs, exact=True)
    rows = rows.where((F.col("n_dropped") == 0) | F.col("doc.text").rlike(WORD_SQL))
    count = F.when(F.col("n_dropped") == 0, F.col("doc")["n_chars"]).otherwise(F.length("doc.text")) if "n_chars" in docs.columns else None
    kinds = dict(docs.dtypes)
    return rows.select(*((count.cast(kinds[c]) if c == "n_chars" else F.col("doc")[c]).alias(c) for c in docs.columns))


ORACLE = rf"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
t0 AS (SELECT doc_id, text, pos, line, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS w FROM l),
t AS (
  SELECT doc_id, text, pos, line, w, len(w) AS n, array_to_string(w, ' ') AS lh, struct_pack(n := len(w), a := w[1], b := w[2]) AS leaf
  FROM (SELECT doc_id, text, pos, line, [CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END FOR x IN w] AS w FROM t0) WHERE len(w) >= {CONSTANT}),
leaves AS (SELECT leaf FROM t GROUP BY leaf HAVING count(DISTINCT text) >= {LEAST}),
s AS (SELECT t.* FROM t SEMI JOIN leaves ON t.leaf = leaves.leaf),
lines AS (SELECT leaf, lh, any_value(w) AS w, any_value(n) AS n, count(DISTINCT text) AS texts FROM s GROUP BY leaf, lh),
each AS (SELECT leaf, lh, n, texts, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM lines),
steady AS (SELECT leaf, i, word FROM each GROUP BY ALL HAVING sum(texts) >= {LEAST}),
made AS (
  SELECT e.leaf, e.lh, e.n, count(s.word) AS constant, string_agg(CASE WHEN s.word IS NOT NULL THEN e.i || ' ' || e.word END, ' ' ORDER BY e.i) AS kept
  FROM each e LEFT JOIN steady s ON e.leaf = s.leaf AND e.i = s.i AND e.word = s.word WHERE e.word <> '<*>' GROUP BY e.leaf, e.lh, e.n),
tpl AS (SELECT leaf, lh, CASE WHEN constant >= {CONSTANT} AND constant >= n * {SHARE} THEN kept ELSE 'line ' || lh END AS template FROM made),
x AS (SELECT s.*, p.template FROM s JOIN tpl p ON s.leaf = p.leaf AND s.lh = p.lh),
recurring AS (SELECT leaf, template, min(struct_pack(a := doc_id, b := pos)) AS first FROM x GROUP BY leaf, template HAVING count(DISTINCT text) >= {LEAST}),
repeated AS (SELECT line, min(struct_pack(a := doc_id, b := pos)) AS first FROM t WHERE n >= {LONG} GROUP BY line HAVING count(DISTINCT text) >= 2),
places AS (
  SELECT x.doc_id, x.pos FROM x JOIN recurring r ON x.leaf = r.leaf AND x.template = r.template WHERE struct_pack(a := x.doc_id, b := x.pos) <> r.first
  UNION SELECT t.doc_id, t.pos FROM t JOIN repeated r ON t.line = r.line AND t.n >= {LONG} WHERE struct_pack(a := t.doc_id, b := t.pos) <> r.first),
gone AS (SELECT doc_id, list(pos) AS drops FROM places GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(g.drops), 0) AS BIGINT) AS n_dropped,
  CASE WHEN g.drops IS NULL THEN d.text ELSE array_to_string([y FOR y, i IN string_split(d.text, chr(10)) IF NOT list_contains(g.drops, i - 1)], chr(10)) END AS text
FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id
"""
