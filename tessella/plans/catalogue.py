"""Registered queries of the detection engine, and SQL of those that SQL can express."""

from __future__ import annotations

from math import e, factorial, log10

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.config import CONFIG, METHODS, METHODS_25, SCOPES
from tessella.functions import compositional as comp
from tessella.operators import agreement, consensus, counts, fixpoint, inference, outliers, summary, suppress
from tessella.operators.suppress import REGISTRY, SWEEPS
from tessella.plans import sql
from tessella.plans.study import MIN_CELLS, study
from tessella.sources import validate

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SHORT = CONFIG.short
KEYS = ["slide_id", "overlap_pct"]
BLOCK = counts.BLOCK


def query(oracle: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


def real(df: DataFrame, **digits: int) -> DataFrame:
    """Reals rounded half up to six digits, or as many as given by column, by the arithmetic of the SQL."""

    def rounded(c):
        unit = float(10 ** digits.get(c, 6))
        return F.when(F.isnan(c), F.col(c)).otherwise(F.floor(F.col(c) * unit + 0.5) / unit).alias(c)

    return df.select(*(rounded(c) if t == "double" and c not in ("overlap_pct", "confidence") else F.col(c) for c, t in df.dtypes))


def only25(df: DataFrame) -> DataFrame:
    """The 25 variants without edge cropping, which agreement, consensus and ranks are about."""
    return df.where(F.col("nms_method").isin(*METHODS_25))


def reals(*columns: str) -> str:
    return ", ".join(f"{sql.real(c)} AS {c}" for c in columns)


# -- sources ----------------------------------------------------------------------------------------------------------


@query(sql.query([sql.DET], "SELECT det_id, slide_id, overlap_pct, label, confidence, x1, y1, x2, y2, cx, cy, x_correct, y_correct, tile_x, tile_y FROM det"))
def detections(spark, sf_dir):
    return study(spark, sf_dir).detections


@query(sql.query([sql.DET], "SELECT det_id, CAST(x_correct // CASE WHEN overlap_pct = 0 THEN 640 ELSE 480 END AS BIGINT) AS tile_x, CAST(y_correct // CASE WHEN overlap_pct = 0 THEN 640 ELSE 480 END AS BIGINT) AS tile_y FROM det"))
def tile_index(spark, sf_dir):
    rows = study(spark, sf_dir).detections.select("det_id", "overlap_pct", "x_correct", "y_correct")
    return validate.tile_index(rows).select("det_id", "tile_x", "tile_y")


@query(sql.query([sql.DET], f"SELECT {sql.KEY}, avg((x_correct % CASE WHEN overlap_pct = 0 THEN 640 ELSE 480 END = 0)::INT::DOUBLE) AS share_x, avg((y_correct % CASE WHEN overlap_pct = 0 THEN 640 ELSE 480 END = 0)::INT::DOUBLE) AS share_y FROM det GROUP BY ALL"))
def grid_integrity(spark, sf_dir):
    return validate.grid_shares(study(spark, sf_dir).detections)


@query(sql.query([sql.DET], "SELECT slide_id, overlap_pct, max(x2) AS max_x, max(y2) AS max_y, max(x2) <= 2560 + 640 AND max(y2) <= 2560 + 640 AS inside FROM det GROUP BY slide_id, overlap_pct"))
def bounds_check(spark, sf_dir):
    dets = study(spark, sf_dir).detections
    slides = dets.select("slide_id").distinct().withColumns({"image_w": F.lit(2560), "image_h": F.lit(2560)})
    return validate.bounds(dets, slides)


@query(sql.query([sql.DET], "SELECT label, count(*) AS n FROM det WHERE label IN ('Makrophage', 'Lymphozyt') GROUP BY label"))
def label_filter(spark, sf_dir):
    return validate.known_labels(study(spark, sf_dir).detections, ("Makrophage", "Lymphozyt")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(sql.query([sql.DET], f"SELECT DISTINCT slide_id, 'S' || lpad(CAST(dense_rank() OVER (ORDER BY slide_id) AS VARCHAR), 2, '0') AS pseudonym FROM det"))
def pseudonyms(spark, sf_dir):
    return summary.pseudonyms(study(spark, sf_dir).detections)


# -- predicates and suppression ---------------------------------------------------------------------------------------


@query(sql.query([sql.DET], "SELECT det_id, slide_id, overlap_pct, label, confidence FROM det WHERE confidence >= 0.44::DOUBLE"))
def conf_filter(spark, sf_dir):
    return study(spark, sf_dir).confident.select("det_id", "slide_id", "overlap_pct", "label", "confidence")


@query(sql.query([sql.DET], f"SELECT det_id, slide_id, overlap_pct FROM det WHERE {sql.INNER}"))
def edge_filter(spark, sf_dir):
    return study(spark, sf_dir).detections.where(suppress.interior()).select("det_id", "slide_id", "overlap_pct")


@query(sql.query([sql.DET, sql.source("c"), sql.edges("e", "c", "iou", 0.45)], "SELECT k AS killer, v AS victim FROM e"))
def iou_edges(spark, sf_dir):
    return fixpoint.iou_edges(study(spark, sf_dir).confident, CONFIG.iou).select("killer", "victim")


@query(sql.query([sql.DET, sql.source("c"), sql.edges("e", "c", "nn_dist", 20.0)], "SELECT k AS killer, v AS victim FROM e"))
def distance_edges(spark, sf_dir):
    return fixpoint.distance_edges(study(spark, sf_dir).confident, CONFIG.distance)


@query(sql.query([sql.DET, sql.source("c")], f"SELECT {sql.KEY}, label, {sql.real('2 * sd')} AS radius FROM c_r"))
def center_radii(spark, sf_dir):
    return real(suppress.center_radii(study(spark, sf_dir).confident))


def _variant(name: str):
    def run(spark, sf_dir):
        return suppress.survived(study(spark, sf_dir).masked, name).select("det_id", "slide_id", "overlap_pct", "label", "tile_x", "tile_y")

    return run


for _name in METHODS:
    query(sql.one_variant(_name, REGISTRY[_name]), _name)(_variant(_name))


@query(sql.one_variant("iou_grid_n2", REGISTRY["iou_grid_n2"]).replace("SELECT d.det_id, d.slide_id, d.overlap_pct, d.label, d.tile_x, d.tile_y FROM m", "SELECT d.det_id FROM m"))
def iou_grid_n2_by_fixpoint(spark, sf_dir):
    return fixpoint.by_variant(study(spark, sf_dir).detections, REGISTRY["iou_grid_n2"])


def _by_joins(name: str):
    return lambda spark, sf_dir: fixpoint.by_variant(study(spark, sf_dir).detections, REGISTRY[name])


for _name in ("nn_center_grid_n3", "nn_cluster_grid_n4"):
    _all = sql.one_variant(_name, REGISTRY[_name])
    query(_all[: _all.rindex("SELECT")] + "SELECT d.det_id FROM m JOIN det d USING (det_id)", f"{_name}_by_joins")(_by_joins(_name))


def _sweep(prefix: str):
    some = {n: v for n, v in SWEEPS.items() if n.startswith(prefix)}
    names = list(some)

    def run(spark, sf_dir):
        rows = counts.cells(study(spark, sf_dir).settings(prefix), some)
        return rows.select("slide_id", "overlap_pct", F.col("nms_method").alias("setting"), *SHORT)

    wide = ", ".join(f"CAST(count(*) FILTER (d.label = '{label}') AS BIGINT) AS {s}" for label, s in zip(CONFIG.labels, SHORT, strict=True))
    union = " UNION ALL ".join(f"SELECT '{n}' AS setting, det_id FROM w{k}" for k, n in enumerate(names))
    oracle = sql.query([sql.DET, *(sql.survivors(f"w{k}", n, SWEEPS[n]) for k, n in enumerate(names))], f"SELECT d.slide_id, d.overlap_pct, s.setting, {wide} FROM ({union}) s JOIN det d USING (det_id) GROUP BY ALL")
    return run, oracle


for _query, _prefix in (("iou_threshold_sweep", "iou_t"), ("nn_radius_sweep", "nn_dist_r"), ("cluster_radius_sweep", "nn_cluster_r"), ("center_k_sweep", "nn_center_k"), ("iou_classwise", "iou_classwise"), ("confidence_sweep", "none_c"), ("iou_confidence_sweep", "iou_c0"), ("distance_confidence_sweep", "nn_dist_c"), ("center_confidence_sweep", "nn_center_c"), ("cluster_confidence_sweep", "nn_cluster_c")):
    _run, _oracle = _sweep(_prefix)
    query(_oracle, _query)(_run)


@query(sql.query([sql.DET, sql.survivors("t", "t", SWEEPS["iou_c0.37"])], "SELECT d.det_id, d.slide_id, d.overlap_pct FROM t JOIN det d USING (det_id) WHERE d.confidence >= 0.60::DOUBLE"))
def threshold_reuse(spark, sf_dir):
    """Greedy survivors at a higher threshold are those at a lower one, filtered."""
    low = suppress.survived(study(spark, sf_dir).swept, "iou_c0.37", SWEEPS)
    high = study(spark, sf_dir).detections.where(F.col("confidence") >= 0.60).select("det_id")
    return low.join(high, "det_id", "left_semi").select("det_id", "slide_id", "overlap_pct")


# -- counts -----------------------------------------------------------------------------------------------------------

_TOTAL = " + ".join(SHORT)


@query(sql.query(sql.COUNTED, sql.long("cells", f"{sql.KEY}, nms_method", f", {sql.real(f'CASE WHEN {_TOTAL} > 0 THEN {{s}}::DOUBLE / ({_TOTAL}) ELSE 0.0 END')} AS rel_count")))
def cell_counts(spark, sf_dir):
    return real(counts.long(study(spark, sf_dir).cells, rel=True))


@query(sql.query(sql.COUNTED, sql.long("tiles", f"{sql.KEY}, tile_x, tile_y, nms_method")))
def tile_counts(spark, sf_dir):
    return counts.long(study(spark, sf_dir).tiles)


@query(sql.query(sql.COUNTED, sql.long("blocks", f"{sql.BLOCK}, nms_method, n_block_total")))
def block_counts(spark, sf_dir):
    return counts.long(study(spark, sf_dir).blocks)


@query(sql.query(sql.COUNTED, f"SELECT {sql.BLOCK}, nms_method, {', '.join(SHORT)}, n_block_total FROM eligible"))
def eligible_blocks(spark, sf_dir):
    return study(spark, sf_dir).eligible


@query(sql.query(sql.COUNTED, f"SELECT block_size, {sql.real(f'avg((n_block_total >= {MIN_CELLS})::INT::DOUBLE)')} AS retained FROM blocks GROUP BY block_size"))
def min_cells_retained(spark, sf_dir):
    return real(counts.min_cells_filter(study(spark, sf_dir).blocks, MIN_CELLS)[1])


@query(sql.query(sql.COUNTED, f"SELECT block_size, overlap_pct, nms_method, label, count(*) AS n_blocks, CAST(sum((count = 0)::INT) AS BIGINT) AS n_zero, {sql.real('avg((count = 0)::INT::DOUBLE)')} AS frac_zero FROM ({sql.long('eligible', f'{sql.BLOCK}, nms_method')}) GROUP BY ALL"))
def zero_frequencies(spark, sf_dir):
    return real(counts.zero_frequencies(study(spark, sf_dir).eligible))


@query(sql.query(sql.COUNTED, f"SELECT block_size, overlap_pct, nms_method, count(*) AS n_blocks, {sql.real('quantile_cont(n_block_total, 0.5)')} AS median_cells, {sql.real('quantile_cont(n_block_total, 0.05)')} AS q05_cells, min(n_block_total) AS min_cells FROM eligible GROUP BY ALL"))
def cells_per_block(spark, sf_dir):
    return real(counts.cells_per_block(study(spark, sf_dir).eligible))


# -- compositions -----------------------------------------------------------------------------------------------------


def _parts():
    return [F.col(s).cast("double") for s in SHORT]


@query(sql.query([*sql.COUNTED], f"SELECT {sql.BLOCK}, nms_method, " + ", ".join(f"{sql.real(p)} AS p_{s}" for p, s in zip(sql.PARTS, SHORT, strict=True)) + " FROM blocks"))
def zero_replacement(spark, sf_dir):
    rows = study(spark, sf_dir).blocks
    return real(rows.select(*BLOCK, "nms_method", *(p.alias(f"p_{s}") for p, s in zip(comp.replace_zeros(_parts()), SHORT, strict=True))))


@query(sql.query(sql.ON_CELLS, f"SELECT {sql.KEY}, nms_method, {reals('alr_Mac', 'alr_Neu', 'alr_Eos')} FROM ratios"))
def alr(spark, sf_dir):
    return real(inference.log_ratios(study(spark, sf_dir).cells).drop("ilr_1", "ilr_2", "ilr_3"))


@query(sql.query(sql.ON_CELLS, f"SELECT {sql.KEY}, nms_method, {reals('ilr_1', 'ilr_2', 'ilr_3')} FROM ratios"))
def per_slide_ilr(spark, sf_dir):
    return real(inference.log_ratios(study(spark, sf_dir).cells).select(*KEYS, "nms_method", "ilr_1", "ilr_2", "ilr_3"))


@query(sql.query(sql.COUNTED, f"SELECT {sql.BLOCK}, nms_method, {reals('z1', 'z2', 'z3')} FROM ({sql.panel()})"))
def ilr_panel(spark, sf_dir):
    return real(agreement.coordinates(only25(study(spark, sf_dir).eligible)))


@query(sql.query(sql.COUNTED, f"SELECT {sql.BLOCK}, nms_method, {reals('z1', 'z2', 'z3')} FROM ({sql.panel('common_scale')})"))
def common_scale(spark, sf_dir):
    return real(agreement.coordinates(only25(study(spark, sf_dir).eligible), "common_scale"))


@query(sql.query(sql.COUNTED, f"SELECT {sql.BLOCK}, nms_method, {reals('z1', 'z2')} FROM ({sql.panel('no_eos')})"))
def drop_eos(spark, sf_dir):
    return real(agreement.coordinates(only25(study(spark, sf_dir).eligible), "no_eos"))


@query(sql.query(sql.ON_CELLS, f"SELECT {sql.KEY}, nms_method, " + ", ".join(f"{sql.real(x)} AS p_{s}" for x, s in zip(sql.helmert_inverse(["ilr_1", "ilr_2", "ilr_3"]), SHORT, strict=True)) + " FROM ratios"))
def ilr_inverse(spark, sf_dir):
    rows = inference.log_ratios(study(spark, sf_dir).cells)
    back = comp.ilr_inverse([F.col(f"ilr_{k}") for k in (1, 2, 3)])
    return real(rows.select(*KEYS, "nms_method", *(p.alias(f"p_{s}") for p, s in zip(back, SHORT, strict=True))))


_MORE = [*sql.COUNTED, "half AS (SELECT *, Mac + 1 AS a0, Lym + 1 AS a1, Neu + 1 AS a2, Eos + 1 AS a3 FROM blocks)"]
_A = [f"(a{k} / (a0 + a1 + a2 + a3)::DOUBLE)" for k in range(4)]
_B = ["0.25::DOUBLE"] * 4
_GAP = "sqrt(" + " + ".join(f"({x} - {y}) * ({x} - {y})" for x, y in zip(sql.helmert(_A), sql.helmert(_B), strict=True)) + ")"


@query(sql.query(_MORE, f"SELECT {sql.BLOCK}, nms_method, {sql.real(_GAP)} AS distance FROM half"))
def aitchison_distance(spark, sf_dir):
    """Distance of each block's counts plus one to equal parts."""
    rows = study(spark, sf_dir).blocks
    gap = comp.aitchison([F.col(s) + 1.0 for s in SHORT], [F.lit(0.25)] * 4)
    return real(rows.select(*BLOCK, "nms_method", gap.alias("distance")))


_PROPS = [*sql.COUNTED]


def _alternative(name: str, strength: float, common: float | None, digits: int | None = 6):
    parts = list(SHORT)
    if common:
        n = f"({' + '.join(SHORT)})::DOUBLE"
        parts = [f"(CASE WHEN {n} > 0 THEN {s} / {n} * {common}::DOUBLE ELSE 0.0::DOUBLE END)" for s in SHORT]
    names = [f"q{k}" for k in range(4)]
    inner = f"SELECT {sql.KEY}, nms_method, {', '.join(f'{p}::DOUBLE AS {n}' for p, n in zip(parts, names, strict=True))} FROM cells WHERE {_TOTAL} > 0"
    p = sql.replaced(names, strength, fallback=False)
    return f"SELECT '{name}' AS setting, {sql.KEY}, nms_method, " + ", ".join(f"{sql.real(f'ln({p[k]} / {p[1]})', digits) if digits else f'ln({p[k]} / {p[1]})'} AS alr_{SHORT[k]}" for k in (0, 2, 3)) + f" FROM ({inner})"


SETTINGS = {"s=0.5": (0.5, None), "s=0.1": (0.1, None), "s=1.0": (1.0, None), "s=0.5, common total": (0.5, CONFIG.common_total)}


@query(sql.query(sql.COUNTED, " UNION ALL ".join(_alternative(k, *v) for k, v in SETTINGS.items())))
def replacement_sensitivity(spark, sf_dir):
    rows = study(spark, sf_dir).cells
    out = None
    for name, (strength, common) in SETTINGS.items():
        part = inference.log_ratios(rows, strength=strength, common=common, fallback=False).select(F.lit(name).alias("setting"), *KEYS, "nms_method", *inference.COORDS)
        out = part if out is None else out.unionByName(part)
    return real(out)


# -- summaries --------------------------------------------------------------------------------------------------------

_W = "CASE WHEN sum(w) > 0 THEN sum(ilr_{k} * w) / sum(w) ELSE avg(ilr_{k}) END AS ilr_{k}"
_MEANS = f"means AS (SELECT overlap_pct, nms_method, count(*) AS n_slides, {', '.join(_W.format(k=k) for k in (1, 2, 3))} FROM (SELECT *, ({_TOTAL})::DOUBLE AS w FROM ratios) GROUP BY ALL)"
_BACK = sql.helmert_inverse(["ilr_1", "ilr_2", "ilr_3"])


@query(
    sql.query([*sql.ON_CELLS, _MEANS], f"SELECT overlap_pct, nms_method, n_slides, {reals('ilr_1', 'ilr_2', 'ilr_3')}, "
    + ", ".join(f"{sql.real(f'ln({_BACK[k]} / {_BACK[1]})')} AS alr_{SHORT[k]}" for k in (0, 2, 3)) + ", "
    + ", ".join(f"{sql.real(f'{_BACK[k]} * 100')} AS pct_{SHORT[k]}" for k in range(4)) + " FROM means")
)
def weighted_means(spark, sf_dir):
    return real(summary.weighted_means(study(spark, sf_dir).cells))


@query(sql.query(sql.ON_CELLS, f"SELECT a.overlap_pct, a.nms_method AS method_a, b.nms_method AS method_b, {sql.real('avg(sqrt((a.ilr_1 - b.ilr_1) * (a.ilr_1 - b.ilr_1) + (a.ilr_2 - b.ilr_2) * (a.ilr_2 - b.ilr_2) + (a.ilr_3 - b.ilr_3) * (a.ilr_3 - b.ilr_3)))')} AS distance FROM ratios a JOIN ratios b ON a.slide_id = b.slide_id AND a.overlap_pct = b.overlap_pct GROUP BY ALL"))
def distance_matrix(spark, sf_dir):
    return real(summary.distance_matrix(study(spark, sf_dir).cells))


_POOLED = f"pooled AS (SELECT overlap_pct, nms_method, {', '.join(f'sum({s}) AS {s}' for s in SHORT)} FROM cells GROUP BY ALL)"


@query(sql.query([*sql.COUNTED, _POOLED], f"SELECT a.overlap_pct, a.nms_method, {', '.join(f'{sql.real(f'CASE WHEN b.{s} > 0 THEN a.{s}::DOUBLE / b.{s} END')} AS ret_{s}' for s in SHORT)}, {sql.real('(a.Mac + a.Lym + a.Neu + a.Eos)::DOUBLE / (b.Mac + b.Lym + b.Neu + b.Eos)')} AS ret_total FROM pooled a JOIN pooled b ON a.overlap_pct = b.overlap_pct AND b.nms_method = 'none'"))
def retention(spark, sf_dir):
    return real(summary.retention(study(spark, sf_dir).cells))


_PER = f"""per AS (SELECT a.{sql.KEY.replace(', ', ', a.')}, a.nms_method, {', '.join(f'CASE WHEN b.{s} > 0 THEN a.{s}::DOUBLE / b.{s} END AS ret_{s}' for s in SHORT)},
  a.Mac + a.Lym + a.Neu + a.Eos AS n, b.Mac + b.Lym + b.Neu + b.Eos AS n0 FROM cells a JOIN cells b ON a.slide_id = b.slide_id AND a.overlap_pct = b.overlap_pct AND b.nms_method = 'none' WHERE a.nms_method <> 'none'),
per2 AS (SELECT *, CASE WHEN ret_Eos > 0 AND ret_Lym > 0 THEN ln(ret_Eos) - ln(ret_Lym) END AS ratio FROM per)"""


@query(sql.query([*sql.COUNTED, _PER], f"SELECT overlap_pct, nms_method, count(*) AS n_slides, {', '.join(f'{sql.real(f'median(ret_{s})')} AS median_ret_{s}' for s in SHORT)}, {sql.real('median(ratio)')} AS median_log_ret_ratio_Eos_Lym, CAST(sum((ratio > 0)::INT) AS BIGINT) AS n_slides_Eos_retained_more, {sql.real('sum(n)::DOUBLE / sum(n0)')} AS pooled_ret_total FROM per2 GROUP BY ALL"))
def retention_per_slide(spark, sf_dir):
    return real(summary.retention_per_slide(study(spark, sf_dir).cells))


_PCT = f"pct AS (SELECT {sql.KEY}, nms_method, {', '.join(f'CASE WHEN {_TOTAL} > 0 THEN {s} * 100.0::DOUBLE / ({_TOTAL}) ELSE 0.0 END AS pct_{s}' for s in SHORT)} FROM cells)"


@query(sql.query([*sql.COUNTED, _PCT], f"SELECT {sql.KEY}, nms_method, {reals(*(f'pct_{s}' for s in SHORT))} FROM pct"))
def slide_percentages(spark, sf_dir):
    return real(summary.percentages(study(spark, sf_dir).cells))


_POS = "pos AS (" + " UNION ALL ".join(f"SELECT {sql.KEY}, nms_method, '{s}' AS class, pct_{s} > {v}::DOUBLE AS positive FROM pct" for s, v in summary.LIMITS.items()) + ")"


@query(sql.query([*sql.COUNTED, _PCT, _POS], "SELECT a.overlap_pct, a.nms_method, a.class, CAST(sum(a.positive::INT) AS BIGINT) AS n_positive, CAST(sum((a.positive <> b.positive)::INT) AS BIGINT) AS n_changed, coalesce(string_agg(CASE WHEN a.positive <> b.positive THEN a.slide_id END, ';' ORDER BY a.slide_id), '') AS slides_changed FROM pos a JOIN pos b ON a.slide_id = b.slide_id AND a.overlap_pct = b.overlap_pct AND a.class = b.class AND b.nms_method = 'none' WHERE a.nms_method <> 'none' GROUP BY ALL"))
def classification_changes(spark, sf_dir):
    return summary.classification_changes(study(spark, sf_dir).cells)


# -- agreement --------------------------------------------------------------------------------------------------------


def _sums(spark, sf_dir, regime="as_is"):
    return agreement.slide_sums(agreement.coordinates(only25(study(spark, sf_dir).eligible), regime), len(METHODS_25))


@query(sql.query(sql.COUNTED, f"SELECT block_size, overlap_pct, n_blocks, alpha FROM ({sql.alpha()})"))
def alpha_by_scale(spark, sf_dir):
    return real(agreement.alpha(_sums(spark, sf_dir), len(METHODS_25)).select("block_size", "overlap_pct", "n_blocks", "alpha"))


@query(sql.query(sql.COUNTED, f"SELECT block_size, overlap_pct, alpha_coord_1, alpha_coord_2, alpha_coord_3 FROM ({sql.alpha()})"))
def alpha_per_coordinate(spark, sf_dir):
    return real(agreement.alpha(_sums(spark, sf_dir), len(METHODS_25)).drop("n_blocks", "alpha"))


@query(sql.query([*sql.COUNTED, f"x AS ({sql.alpha()})", f"y AS ({sql.alpha('common_scale')})", f"z AS ({sql.alpha('no_eos')})"], "SELECT x.block_size, x.overlap_pct, x.n_blocks, x.alpha AS alpha_as_is, x.alpha_coord_1, x.alpha_coord_2, x.alpha_coord_3, y.alpha AS alpha_common_scale, z.alpha AS alpha_no_eos FROM x JOIN y USING (block_size, overlap_pct) JOIN z USING (block_size, overlap_pct)"))
def alpha_zero_sensitivity(spark, sf_dir):
    return real(agreement.zero_sensitivity(only25(study(spark, sf_dir).eligible), len(METHODS_25)).drop("gap"))


_PLACES = "SELECT block_size, overlap_pct, count(DISTINCT (slide_id, block_x, block_y)) AS k FROM {} WHERE nms_method NOT LIKE 'iou_edgecrop%' GROUP BY block_size, overlap_pct"
_INTERVAL = f"{sql.real('median')} AS median, {sql.real('ci_low')} AS ci_low, {sql.real('ci_high')} AS ci_high"


@query(sql.query([*sql.COUNTED, *sql.slide_bootstrap()], f"SELECT a.block_size, a.overlap_pct, {sql.real('c.alpha')} AS alpha, {sql.real('c.lo95')} AS lo95, {sql.real('c.hi95')} AS hi95, coalesce(c.n_blocks_used, 0) AS n_blocks_used, a.k - coalesce(e.k, 0) AS n_blocks_filtered FROM ({_PLACES.format('blocks')}) a LEFT JOIN ({_PLACES.format('eligible')}) e USING (block_size, overlap_pct) LEFT JOIN curve c USING (block_size, overlap_pct)"))
def alpha_bootstrap_ci(spark, sf_dir):
    """The scale curve of the 25 variants with bootstrap intervals over slides."""
    st = study(spark, sf_dir)
    return real(agreement.scale_curve(only25(st.blocks), only25(st.eligible), len(METHODS_25)))


@query()
def alpha_block_bootstrap(spark, sf_dir):
    """Alpha of the 25 variants with bootstrap intervals over blocks."""
    return agreement.block_bootstrap(agreement.coordinates(only25(study(spark, sf_dir).eligible)), len(METHODS_25))


_CENTER = sql.helmert_inverse(["y1", "y2", "y3"])


@query(sql.query([*sql.DEVIATIONS, f"one AS (SELECT {sql.BLOCK}, any_value(y1) AS y1, any_value(y2) AS y2, any_value(y3) AS y3, count(*) AS m FROM dev GROUP BY {sql.BLOCK})"], f"SELECT one.{sql.BLOCK.replace(', ', ', one.')}, " + ", ".join(f"{sql.real(f'ln({_CENTER[k]} / {_CENTER[1]})', 4)} AS consensus_alr_{SHORT[k]}" for k in (0, 2, 3)) + f", m AS n_methods_in_consensus, t.n_block_total FROM one LEFT JOIN blocks t ON {' AND '.join(f'one.{c} = t.{c}' for c in sql.BLOCK.split(', '))} AND t.nms_method = 'none'"))
def block_consensus(spark, sf_dir):
    rows = consensus.block_consensus(study(spark, sf_dir).deviations, study(spark, sf_dir).blocks)
    return real(rows, **{f"consensus_alr_{s}": 4 for s in ("Mac", "Neu", "Eos")})


@query(sql.query(sql.DEVIATIONS, f"SELECT {sql.BLOCK}, nms_method, {sql.real('aitchison', 4)} AS aitchison_distance, {sql.real('mahalanobis', 4)} AS mahalanobis_distance FROM dev"))
def method_deviation(spark, sf_dir):
    return real(consensus.method_deviation(study(spark, sf_dir).deviations), aitchison_distance=4, mahalanobis_distance=4)


# -- outliers ---------------------------------------------------------------------------------------------------------

#: Mahalanobis distances to the consensus; those that agree to seven digits count as tied, in Spark and SQL alike.
_TIED = "tied AS MATERIALIZED (SELECT *, round(mahalanobis, 7) AS distance FROM dev)"
_TAIL = f"tail AS MATERIALIZED (SELECT d.*, d.distance > t.threshold AS in_tail FROM tied d JOIN (SELECT b, quantile_cont(distance, 0.95) AS threshold FROM tied GROUP BY b) t USING (b))"
_FLAG = "flags AS (SELECT block_size, overlap_pct, nms_method, CAST(sum(in_tail::INT) AS BIGINT) AS n_upper, count(*) AS n_blocks FROM tail GROUP BY ALL)"
_OUT = [*sql.DEVIATIONS, _TIED]


def _tied(spark, sf_dir):
    return study(spark, sf_dir).deviations.withColumn("distance", F.round("mahalanobis_distance", 7))


def _tails(spark, sf_dir):
    return outliers.tail_cells(_tied(spark, sf_dir), "distance")


@query(sql.query([*_OUT, _TAIL, _FLAG], f"SELECT *, {sql.real('n_upper::DOUBLE / n_blocks')} AS frac_upper_tail, {sql.real('(sum(n_upper) OVER (PARTITION BY block_size, overlap_pct))::DOUBLE / sum(n_blocks) OVER (PARTITION BY block_size, overlap_pct)')} AS expected_frac FROM flags"))
def tail_flags(spark, sf_dir):
    return real(outliers.tail_flags(_tails(spark, sf_dir)))


@query(sql.query(_OUT, f"SELECT {sql.BLOCK}, nms_method, rank() OVER (PARTITION BY b ORDER BY distance) + (count(*) OVER (PARTITION BY b, distance) - 1) / 2.0::DOUBLE AS rank FROM tied"))
def method_rank(spark, sf_dir):
    return outliers.ranks(_tied(spark, sf_dir), "distance").select(*BLOCK, "nms_method", "rank")


@query(sql.query([*_OUT, "mx AS (SELECT *, (distance = max(distance) OVER (PARTITION BY b))::INT AS is_max FROM tied)", "sh AS (SELECT *, is_max::DOUBLE / sum(is_max) OVER (PARTITION BY b) AS share FROM mx)"], f"SELECT block_size, overlap_pct, nms_method, {sql.real('sum(share) / any_value(u)')} AS frac_largest FROM sh JOIN (SELECT block_size, overlap_pct, count(DISTINCT b) AS u FROM tied GROUP BY ALL) USING (block_size, overlap_pct) GROUP BY block_size, overlap_pct, nms_method"))
def largest_share(spark, sf_dir):
    return real(outliers.largest_share(_tied(spark, sf_dir), "distance"))


_SIGN = [
    *_OUT, _TAIL,
    "ch AS (SELECT block_size, overlap_pct, sum(in_tail::INT)::DOUBLE / count(DISTINCT b) / count(DISTINCT nms_method) AS chance FROM tail GROUP BY ALL)",
    "ow AS (SELECT block_size, overlap_pct, slide_id, avg(in_tail::INT::DOUBLE) AS rate FROM tail WHERE nms_method = 'none' GROUP BY ALL)",
    "sg AS (SELECT block_size, overlap_pct, any_value(chance) AS chance, count(*) AS n_slides, CAST(sum((rate > chance)::INT) AS BIGINT) AS n_slides_above FROM ow JOIN ch USING (block_size, overlap_pct) GROUP BY block_size, overlap_pct)",
    "sp AS (SELECT *, list_sum([factorial(n_slides::INT)::DOUBLE / (factorial(i::INT)::DOUBLE * factorial((n_slides - i)::INT)::DOUBLE) FOR i IN range(n_slides_above, n_slides + 1)]) / 2.0::DOUBLE ** n_slides AS p FROM sg)",
]


@query(sql.query(_SIGN, f"SELECT block_size, overlap_pct, {sql.real('chance')} AS chance, n_slides, n_slides_above, {sql.real('p')} AS p_sign FROM sp"))
def sign_test(spark, sf_dir):
    return real(outliers.sign_test(_tails(spark, sf_dir)))


@query(sql.query([*_SIGN, "st AS (SELECT *, least(1.0::DOUBLE, p * (count(*) OVER (PARTITION BY overlap_pct) - row_number() OVER (PARTITION BY overlap_pct ORDER BY p, block_size) + 1)) AS s FROM sp)"], f"SELECT block_size, overlap_pct, {sql.real('p')} AS p_value, {sql.real('max(s) OVER (PARTITION BY overlap_pct ORDER BY p, block_size ROWS UNBOUNDED PRECEDING)')} AS p_holm FROM st"))
def holm(spark, sf_dir):
    """The sign tests of all block sizes at an overlap as one family, stepped down."""
    rows = outliers.sign_test(_tails(spark, sf_dir)).select("block_size", "overlap_pct", F.col("p_sign").alias("p_value"))
    return real(inference.holm(rows, ["overlap_pct"]))


_WESTFALL = [*_OUT, _TAIL, _FLAG, *sql.permutation()]


@query(sql.query(_WESTFALL, f"SELECT block_size, overlap_pct, nms_method, n_upper, n_blocks, {sql.real('frac_upper_tail')} AS frac_upper_tail, {sql.real('expected_frac')} AS expected_frac, {sql.real('p_value')} AS p_value, flagged_outlier FROM wy"))
def westfall_young(spark, sf_dir):
    return real(outliers.permutation(_tails(spark, sf_dir)))


@query(sql.query(_WESTFALL, f"SELECT nms_method, CAST(sum(flagged_outlier::INT) AS BIGINT) AS n_settings_flagged, count(*) AS n_settings_total, {sql.real('avg(flagged_outlier::INT::DOUBLE)')} AS frac_settings_flagged, {sql.real('avg(frac_upper_tail)')} AS mean_frac_upper_tail FROM wy GROUP BY nms_method"))
def outlier_summary(spark, sf_dir):
    return real(outliers.summary(outliers.permutation(_tails(spark, sf_dir))))


def _box(source: str, keys: str, value: str) -> list[str]:
    """CTEs for ``box``: what a box plot of a value shows."""
    cut = ", ".join(f"quantile_cont({value}, {q}) AS {n}" for n, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)))
    inside = f"{value} BETWEEN q25 - (q75 - q25) * {summary.WHISKER!r}::DOUBLE AND q75 + (q75 - q25) * {summary.WHISKER!r}::DOUBLE"
    return [
        f"qs AS (SELECT {keys}, {cut} FROM {source} GROUP BY {keys})",
        f"box AS (SELECT {keys}, count(*) AS n, min({value}) AS low, min({value}) FILTER ({inside}) AS whisker_low, any_value(q25) AS q25, any_value(median) AS median, any_value(q75) AS q75, "
        f"max({value}) FILTER ({inside}) AS whisker_high, max({value}) AS high, count(*) FILTER (NOT ({inside})) AS n_outside FROM {source} JOIN qs USING ({keys}) GROUP BY {keys})",
    ]


#: Distances to six digits; quartiles between them take two more.
_ENDS = ["low", "whisker_low", "q25", "median", "q75", "whisker_high", "high"]


@query(sql.query([*sql.DEVIATIONS, "far AS MATERIALIZED (SELECT *, round(aitchison, 6) AS distance FROM dev)", *_box("far", "overlap_pct, block_size, nms_method", "distance")], f"SELECT overlap_pct, block_size, nms_method, n, {', '.join(f'{sql.real(c, 8)} AS {c}' for c in _ENDS)}, n_outside FROM box"))
def distance_boxes(spark, sf_dir):
    """The box plot of each variant's distances to the consensus."""
    rows = study(spark, sf_dir).deviations.withColumn("distance", F.round("aitchison_distance", 6))
    return real(summary.boxes(rows, "distance", ["overlap_pct", "block_size", "nms_method"]), **dict.fromkeys(_ENDS, 8))


# -- inference --------------------------------------------------------------------------------------------------------


def _ratios(spark, sf_dir, columns=inference.COORDS):
    return inference.long_ratios(inference.log_ratios(study(spark, sf_dir).cells), columns)


def _ranked(spark, sf_dir):
    return only25(_ratios(spark, sf_dir, ["ilr_1", "ilr_2", "ilr_3"])).withColumn("value", F.round("value", 9))


_RANKS = """rk AS (SELECT *, rank() OVER (PARTITION BY overlap_pct, coord, slide_id ORDER BY value) + (count(*) OVER t - 1) / 2.0::DOUBLE AS r, (count(*) OVER t) ** 2 - 1 AS t2
  FROM lilr WINDOW t AS (PARTITION BY overlap_pct, coord, slide_id, value)),
rs AS (SELECT overlap_pct, coord, nms_method, sum(r) AS r, count(*) AS n, sum(t2) AS t FROM rk GROUP BY ALL)"""
_K = len(METHODS_25)
_CHI = f"(12.0::DOUBLE / (any_value(n) * {_K} * {_K + 1}) * sum(r * r) - 3.0::DOUBLE * any_value(n) * {_K + 1}) / (1.0::DOUBLE - sum(t) / (any_value(n) * {_K} * {_K * _K - 1}))"
#: The tail of chi-squared with an even number of degrees of freedom is a finite sum.
_TERMS = " + ".join(f"(statistic / 2) ** {j} / {factorial(j)}.0::DOUBLE" for j in range((_K - 1) // 2))
_FRIEDMAN = [
    *sql.ON_CELLS, _RANKS,
    f"fr AS (SELECT overlap_pct, coord, {_CHI} AS statistic, any_value(n) AS n FROM rs GROUP BY ALL)",
    f"fp AS (SELECT *, -statistic / 2 * {log10(e)!r}::DOUBLE + log10({_TERMS}) AS lp FROM fr)",
    "fs AS (SELECT *, 10.0::DOUBLE ** lp AS p, least(1.0::DOUBLE, 10.0::DOUBLE ** lp * (count(*) OVER (PARTITION BY overlap_pct) - row_number() OVER (PARTITION BY overlap_pct ORDER BY 10.0::DOUBLE ** lp, coord) + 1)) AS s FROM fp)",
]


@query(sql.query(_FRIEDMAN, f"SELECT overlap_pct, coord, {sql.real('statistic')} AS statistic, CAST({_K - 1} AS BIGINT) AS df, {sql.real(f'statistic / (n * {_K - 1})')} AS kendall_w, n AS n_subjects, CAST({_K} AS BIGINT) AS n_methods, {sql.real('lp')} AS log10_p, {sql.real('p')} AS p_value, {sql.real('max(s) OVER (PARTITION BY overlap_pct ORDER BY p, coord ROWS UNBOUNDED PRECEDING)')} AS p_holm FROM fs"))
def friedman(spark, sf_dir):
    """Friedman's test across the 25 variants, with its p-values."""
    return real(inference.friedman(_ranked(spark, sf_dir)))


@query(sql.query([*sql.ON_CELLS, _RANKS], f"SELECT overlap_pct, coord, nms_method, {sql.real('r / n')} AS mean_rank, n FROM rs"))
def mean_ranks(spark, sf_dir):
    return real(inference.mean_ranks(_ranked(spark, sf_dir)))


@query(sql.query([*sql.ON_CELLS, _RANKS], f"SELECT a.overlap_pct, a.coord, a.nms_method AS method_a, b.nms_method AS method_b, {sql.real(f'abs(a.r / a.n - b.r / b.n) / sqrt({_K * (_K + 1)} / (12.0::DOUBLE * a.n))')} AS q FROM rs a JOIN rs b ON a.overlap_pct = b.overlap_pct AND a.coord = b.coord AND a.nms_method < b.nms_method"))
def mean_rank_differences(spark, sf_dir):
    """The studentised rank difference of each pair of variants."""
    return real(inference.nemenyi(_ranked(spark, sf_dir)).drop("p_value"))


@query()
def mean_rank_pairs(spark, sf_dir):
    """The same with p-values of the studentised range, which has no closed form."""
    return inference.nemenyi(_ranked(spark, sf_dir))


_DIST = "count(diff) AS n, " + ", ".join(f"{sql.real(f'quantile_cont(diff, {q})')} AS {c}" for c, q in (("median", 0.5), ("q05", 0.05), ("q95", 0.95))) + f", {sql.real('min(diff)')} AS min, {sql.real('max(diff)')} AS max, CAST(sum((abs(diff) > 0.2::DOUBLE)::INT) AS BIGINT) AS n_outside, CAST(sum((abs(diff) > 0.1::DOUBLE)::INT) AS BIGINT) AS n_outside_half"


@query(sql.query(sql.ON_CELLS, f"SELECT overlap_pct, nms_method, coord, {_DIST} FROM diffs GROUP BY ALL"))
def slide_level_distribution(spark, sf_dir):
    return real(inference.distribution(inference.differences(_ratios(spark, sf_dir)), ["overlap_pct", "nms_method", "coord"]))


def _tested(spark, sf_dir):
    diffs = inference.differences(_ratios(spark, sf_dir))
    return inference.equivalence(diffs, ["overlap_pct", "nms_method", "coord"])


_TESTED = [*sql.ON_CELLS, *sql.intervals("tested", "diffs", "overlap_pct, nms_method, coord")]


@query(sql.query(_TESTED, f"SELECT overlap_pct, nms_method, coord, n, {_INTERVAL}, equivalent FROM tested"))
def equivalence_vs_none(spark, sf_dir):
    return real(_tested(spark, sf_dir))


@query(sql.query(_TESTED, f"SELECT overlap_pct, nms_method, coord, n, {_INTERVAL}, margin, NOT isnan(ci_low) AND ci_low > -margin AND ci_high < margin AS equivalent FROM tested, (VALUES (0.1::DOUBLE), (0.15), (0.2)) m(margin)"))
def margin_sensitivity(spark, sf_dir):
    return real(inference.margins(_tested(spark, sf_dir)))


@query(sql.query(_TESTED, "SELECT overlap_pct, bool_and(equivalent) AS all_equivalent, coalesce(bool_and(equivalent) FILTER (nms_method = 'iou_grid_n1'), false) AS reference_equivalent FROM tested GROUP BY overlap_pct"))
def equivalence_verdicts(spark, sf_dir):
    return inference.verdicts(_tested(spark, sf_dir))


def _medians(diffs, keys):
    return real(diffs.groupBy(*keys).agg(F.count("diff").alias("n"), F.median("diff").alias("median")))


_MEDIAN = f"count(diff) AS n, {sql.real('median(diff)')} AS median"


def _cropped(spark, sf_dir):
    pairs = spark.createDataFrame([(s, f"iou_edgecrop_{s}", f"iou_{s}") for s in SCOPES], "scope string, method string, other string")
    return inference.paired(_ratios(spark, sf_dir), pairs)


_CROP = "crop AS (SELECT a.overlap_pct, replace(a.nms_method, 'iou_edgecrop_', '') AS scope, a.coord, a.value - b.value AS diff FROM alr a JOIN alr b ON a.slide_id = b.slide_id AND a.overlap_pct = b.overlap_pct AND a.coord = b.coord AND a.nms_method LIKE 'iou_edgecrop%' AND b.nms_method = 'iou_' || replace(a.nms_method, 'iou_edgecrop_', ''))"


@query(sql.query([*sql.ON_CELLS, _CROP, *sql.intervals("tested", "crop", "overlap_pct, scope, coord")], f"SELECT overlap_pct, scope, coord, n, {_INTERVAL}, equivalent FROM tested"))
def edgecrop_vs_iou(spark, sf_dir):
    return real(inference.equivalence(_cropped(spark, sf_dir), ["overlap_pct", "scope", "coord"]))


@query(sql.query([*sql.ON_CELLS, _CROP], f"SELECT overlap_pct, scope, coord, {_MEDIAN} FROM crop GROUP BY ALL"))
def edgecrop_vs_iou_medians(spark, sf_dir):
    return _medians(_cropped(spark, sf_dir), ["overlap_pct", "scope", "coord"])


def _settings(spark, sf_dir):
    rows = inference.long_ratios(inference.log_ratios(counts.cells(study(spark, sf_dir).swept, SWEEPS)))
    return inference.differences(rows, "none_c0.44")


_SETTINGS = [*sql.swept(SWEEPS), sql.differences("sd", "none_c0.44")]


@query(sql.query([*_SETTINGS, *sql.intervals("tested", "sd", "overlap_pct, nms_method, coord")], f"SELECT overlap_pct, nms_method, coord, n, {_INTERVAL}, equivalent FROM tested"))
def parameter_equivalence(spark, sf_dir):
    """Each parameter setting against no suppression at the study's confidence."""
    return real(inference.equivalence(_settings(spark, sf_dir), ["overlap_pct", "nms_method", "coord"]))


@query(sql.query(_SETTINGS, f"SELECT overlap_pct, nms_method, coord, {_MEDIAN} FROM sd GROUP BY ALL"))
def parameter_medians(spark, sf_dir):
    return _medians(_settings(spark, sf_dir), ["overlap_pct", "nms_method", "coord"])


# -- work lists -------------------------------------------------------------------------------------------------------

@query(sql.query([*sql.COUNTED, "done AS (SELECT slide_id, overlap_pct, nms_method FROM cells WHERE nms_method NOT LIKE 'iou_edgecrop%')"], "SELECT slide_id, overlap_pct, nms_method FROM cells ANTI JOIN done USING (slide_id, overlap_pct, nms_method)"))
def pending_work(spark, sf_dir):
    """What a run of all variants has left after a run of the 25 without edge cropping."""
    rows = study(spark, sf_dir).cells
    return validate.pending(rows.select(*KEYS).distinct(), list(METHODS), only25(rows))


@query(sql.query([*sql.COUNTED, f"tt AS (SELECT slide_id, overlap_pct, nms_method, median({_TOTAL}) AS m FROM tiles GROUP BY ALL)"], f"SELECT overlap_pct, nms_method, {sql.real('median(m)')} AS median, count(*) AS n_units FROM tt GROUP BY ALL"))
def median_cells_per_tile(spark, sf_dir):
    """The median over slides of the median tile: the aggregation that timings take as well."""
    rows = study(spark, sf_dir).tiles.withColumn("n", counts.total())
    return real(validate.median_of_medians(rows, "n", ["slide_id"], ["overlap_pct", "nms_method"]))


def _replaced(spark, sf_dir):
    diffs = None
    for name, (strength, common) in SETTINGS.items():
        ratios = inference.log_ratios(study(spark, sf_dir).cells, strength=strength, common=common, fallback=False)
        part = inference.differences(inference.long_ratios(ratios)).withColumn("setting", F.lit(name))
        diffs = part if diffs is None else diffs.unionByName(part)
    return diffs


_OTHERS = "others AS MATERIALIZED (" + " UNION ALL ".join(_alternative(k, *v, digits=None) for k, v in SETTINGS.items()) + ")"
_OTHER = "other AS (" + " UNION ALL ".join(f"SELECT setting, {sql.KEY}, nms_method, '{c}' AS coord, {c} AS value FROM others" for c in inference.COORDS) + ")"


_REPLACED = [*sql.COUNTED, _OTHERS, _OTHER, sql.differences("od", "none", "other", "setting")]


@query(sql.query([*_REPLACED, *sql.intervals("tested", "od", "setting, overlap_pct, nms_method, coord")], f"SELECT setting, overlap_pct, nms_method, coord, n, {_INTERVAL}, equivalent FROM tested"))
def replacement_equivalence(spark, sf_dir):
    """Equivalence to no suppression under each way of replacing zeros."""
    return real(inference.equivalence(_replaced(spark, sf_dir), ["setting", "overlap_pct", "nms_method", "coord"]))


@query(sql.query(_REPLACED, f"SELECT setting, overlap_pct, nms_method, coord, {_MEDIAN} FROM od GROUP BY ALL"))
def replacement_medians(spark, sf_dir):
    return _medians(_replaced(spark, sf_dir), ["setting", "overlap_pct", "nms_method", "coord"])


@query()
def dendrogram(spark, sf_dir):
    """Average-linkage merges of the 31 variants at no overlap; a cluster made in step k is numbered 31 + k."""
    merges = summary.dendrogram(summary.distance_matrix(study(spark, sf_dir).cells), 0.0)
    rows = [(k, a, b, h, n) for k, (a, b, h, n, _) in enumerate(merges)]
    return spark.createDataFrame(rows, "step int, cluster_a int, cluster_b int, height double, size int")


@query(sql.query([*sql.COUNTED, "names AS (SELECT DISTINCT slide_id, 'S' || lpad(CAST(dense_rank() OVER (ORDER BY slide_id) AS VARCHAR), 2, '0') AS pseudonym FROM det)"], f"SELECT n.pseudonym, c.overlap_pct, c.nms_method, c.label, c.count FROM ({sql.long('cells', f'{sql.KEY}, nms_method')}) c JOIN names n USING (slide_id)"))
def slide_counts_export(spark, sf_dir):
    """Slide counts under pseudonyms, as they are published."""
    st = study(spark, sf_dir)
    return summary.pseudonymised(counts.long(st.cells), st.detections)


@query()
def method_times(spark, sf_dir):
    """CPU and wall time of the 31 variants on five slides that have every overlap, three repeats each."""
    from tessella.plans import jobs

    dets = study(spark, sf_dir).detections
    return jobs.times(dets.join(jobs.representative(dets, 5), "slide_id", "left_semi"), repeats=3)


#: Sweep settings that are the registered rules under another name, two that are not, and one that nothing matches.
_SAME = {"iou_t0.45": "iou_grid_n1", "nn_dist_r20": "nn_dist_grid_n1", "nn_center_k2": "nn_center_grid_n1", "nn_cluster_r20": "nn_cluster_grid_n1", "iou_t0.60": "iou_edgecrop_grid_n1", "none_c0.37": "none", "iou_classwise": "unregistered"}
_GAPS = [f"abs(a.{s} - b.{s})" for s in SHORT]


@query(sql.query(
    [*sql.COUNTED, *sql.swept({n: SWEEPS[n] for n in _SAME}, "swept", "v"), f"theirs AS (SELECT slide_id, overlap_pct, n.method AS nms_method, {', '.join(SHORT)} FROM swept JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _SAME.items())}) n(setting, method) ON n.setting = swept.nms_method)",
     f"ours AS (SELECT {sql.KEY}, nms_method, {', '.join(SHORT)} FROM cells WHERE nms_method IN ({', '.join(f"'{v}'" for v in [*_SAME.values(), 'iou_global'])}))"],
    f"SELECT {sql.KEY}, nms_method, CASE WHEN b.Mac IS NULL THEN 'only left' WHEN a.Mac IS NULL THEN 'only right' WHEN greatest({', '.join(_GAPS)}) <= 2 THEN 'agrees' ELSE 'differs' END AS status, "
    + ", ".join(f"{g}::DOUBLE AS gap_{s}" for g, s in zip(_GAPS, SHORT, strict=True)) + f" FROM ours a FULL OUTER JOIN theirs b USING ({sql.KEY}, nms_method)"))
def validation_merge(spark, sf_dir):
    """Counts of registered variants against those of parameter settings that should equal them, to two cells."""
    st = study(spark, sf_dir)
    names = F.create_map(*(F.lit(x) for pair in _SAME.items() for x in pair))
    theirs = counts.cells(st.swept, SWEEPS).where(F.col("nms_method").isin(*_SAME)).withColumn("nms_method", names[F.col("nms_method")])
    ours = st.cells.where(F.col("nms_method").isin(*_SAME.values(), "iou_global"))
    return validate.compare(ours, theirs, [*KEYS, "nms_method"], {s: 2.0 for s in SHORT})
