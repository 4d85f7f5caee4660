"""The jobs as registered queries: each runs twice into one new folder and returns the output as it then stands."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import common, corpus_composition, suppression_report
from tessella.config import CONFIG
from tessella.operators.suppress import REGISTRY
from tessella.plans import sql
from tessella.sources.scratch import scratch_root


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def job1_corpus_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _folder(spark, "job1")
    for _ in range(2):  # the table may be one file, which a file stream takes by a pattern only
        corpus_composition.run(spark, f"{sf_dir}/documents.parquet*", f"{place}/output", f"{place}/checkpoint")
    return corpus_composition.read(spark, f"{place}/output")


def job2_suppression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _folder(spark, "job2")
    for _ in range(2):
        suppression_report.run(spark, f"{sf_dir}/lineitem.parquet", place)
    return suppression_report.read(spark, place)


def _composition_sql() -> str:
    c = common.config("corpus_composition")
    names, at = c["classes"], c["classes"].index(c["reference"])
    words, docs = [f"w{k}" for k in range(len(names))], [f"d{k}" for k in range(len(names))]
    sums = ", ".join(f"CAST(count(*) FILTER (lang = '{n}') AS BIGINT) AS {d}, CAST(coalesce(sum(n) FILTER (lang = '{n}'), 0) AS BIGINT) AS {w}" for n, d, w in zip(names, docs, words, strict=True))
    mine, corpus = sql.replaced(words, c["strength"]), sql.replaced([f"a{k}" for k in range(len(names))], c["strength"])
    p, q = [f"p{k}" for k in range(len(names))], [f"q{k}" for k in range(len(names))]
    square = " + ".join(f"({x} - {y}) * ({x} - {y})" for x, y in zip(sql.helmert(p), sql.helmert(q), strict=True))
    each = " UNION ALL ".join(
        f"SELECT source, d{k} AS n_docs, w{k} AS n_words, {sql.real(f'w{k}::DOUBLE / ({chr(43).join(words)})')} AS share, {sql.real(f'ln(p{k} / p{at})')} AS alr, "
        f"{sql.real(f'ln(p{k} / p{at}) - ln(q{k} / q{at})')} AS gap, {sql.real(f'sqrt({square})')} AS distance, '{n}' AS lang FROM parts"
        for k, n in enumerate(names)
    )
    return sql.query(
        [
            rf"said AS (SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '{corpus_composition.WORD}')) AS n FROM documents WHERE lang IN ({', '.join(f"'{n}'" for n in names)}))",
            f"wide AS (SELECT source, {sums} FROM said GROUP BY source)",
            f"sums AS (SELECT *, {', '.join(f'CAST(sum({w}) OVER () AS BIGINT) AS a{k}' for k, w in enumerate(words))} FROM wide)",
            f"parts AS MATERIALIZED (SELECT *, {', '.join(f'{x} AS p{k}' for k, x in enumerate(mine))}, {', '.join(f'{x} AS q{k}' for k, x in enumerate(corpus))} FROM sums WHERE {' + '.join(words)} > 0)",
            f"rows_ AS ({each})",
        ],
        f"SELECT source, n_docs, n_words, share, alr, gap, distance, abs(gap) > {c['margin']}::DOUBLE AS outside, lang FROM rows_",
    )


def _report_sql() -> str:
    c = common.config("suppression_report")
    chosen = {m: REGISTRY[m] for m in c["variants"]}
    short, others = CONFIG.short, suppression_report.OTHERS
    total = " + ".join(short)
    wide = ", ".join(f"CAST(count(*) FILTER (d.label = '{label}' AND s.det_id IS NOT NULL) AS BIGINT) AS {s}" for label, s in zip(CONFIG.labels, short, strict=True))
    union = " UNION ALL ".join(f"SELECT '{m}' AS nms_method, det_id FROM m{k}" for k, m in enumerate(chosen))
    names = ", ".join(f"('{m}')" for m in chosen)
    pct = ", ".join(f"{sql.real(f'CASE WHEN {total} > 0 THEN {s} * 100.0::DOUBLE / ({total}) ELSE 0.0 END')} AS pct_{s}" for s in short)
    diffs = ", ".join(f"{sql.real(f'alr_{s} - first_value(alr_{s}) OVER b')} AS diff_{s}" for s in others)
    parts = ("diff", "low", "high")
    none = lambda names: ", ".join(f"NULL::DOUBLE AS {n}" for n in names)
    tested = ", ".join(f"max({c}) FILTER (coord = 'alr_{s}') AS {p}_{s}" for p, c in zip(parts, ("median", "ci_low", "ci_high"), strict=True) for s in others)
    kept = f"{sql.real(f'({total})::DOUBLE / nullif(first_value({total}) OVER b, 0)')} AS retained"
    order = f"ORDER BY nms_method <> '{c['reference']}'"
    columns = ", ".join(["slide_id", "nms_method", *short, *(f"pct_{s}" for s in short), "retained", *(f"{p}_{s}" for p in ("alr", *parts) for s in others), "within", "overlap_pct"])
    return sql.query(
        [
            sql.DET, *(sql.survivors(f"m{k}", m, v) for k, (m, v) in enumerate(chosen.items())), f"surv AS MATERIALIZED ({union})",
            f"cells AS MATERIALIZED (SELECT d.slide_id, d.overlap_pct, t.nms_method, {wide} FROM det d CROSS JOIN (VALUES {names}) t(nms_method) LEFT JOIN surv s ON s.det_id = d.det_id AND s.nms_method = t.nms_method GROUP BY ALL)",
            sql.RATIOS, sql.LONG_ALR, sql.DIFFS, *sql.intervals("tested", "diffs", "overlap_pct, nms_method, coord", c["margin"]),
            f"rep AS (SELECT c.*, {pct}, {kept}, {', '.join(f'{sql.real(f"alr_{s}")} AS alr_{s}' for s in others)}, {diffs}, {none(f'{p}_{s}' for p in ('low', 'high') for s in others)} "
            f"FROM cells c LEFT JOIN (SELECT slide_id, overlap_pct, nms_method, {', '.join(f'alr_{s}' for s in others)} FROM ratios) r USING (slide_id, overlap_pct, nms_method) "
            f"WINDOW b AS (PARTITION BY slide_id, overlap_pct {order}))",
            f"pooled AS (SELECT overlap_pct, nms_method, {', '.join(f'CAST(sum({s}) AS BIGINT) AS {s}' for s in short)} FROM cells GROUP BY ALL)",
            f"verdicts AS (SELECT overlap_pct, nms_method, {tested}, bool_and(equivalent) AS within FROM tested GROUP BY ALL)",
            f"study AS (SELECT NULL::VARCHAR AS slide_id, p.*, {pct}, {kept}, {none(f'alr_{s}' for s in others)}, {', '.join(f'{sql.real(f"{p}_{s}")} AS {p}_{s}' for p in parts for s in others)}, within "
            f"FROM pooled p LEFT JOIN verdicts USING (overlap_pct, nms_method) WINDOW b AS (PARTITION BY overlap_pct {order}))",
        ],
        f"SELECT {columns} FROM (SELECT *, greatest({', '.join(f'abs(diff_{s})' for s in others)}) <= {c['margin']}::DOUBLE AS within FROM rep) UNION ALL SELECT {columns} FROM study",
    )


QUERIES = {"job1_corpus_composition": job1_corpus_composition, "job2_suppression_report": job2_suppression_report}
ORACLES = {"job1_corpus_composition": _composition_sql(), "job2_suppression_report": _report_sql()}
