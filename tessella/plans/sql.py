"""DuckDB SQL for the registered queries, put together from common table expressions."""

from __future__ import annotations

from tessella.config import CONFIG, METHODS, METHODS_25
from tessella.functions import resampling
from tessella.operators.suppress import REGISTRY
from tessella.plans.study import MIN_CELLS

SHORT = CONFIG.short
DET = """
b AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS det_id,
  l_suppkey % 8 AS s, l_linenumber % 2 AS o, l_partkey % 4 AS tx, l_orderkey % 4 AS ty,
  (l_partkey * 7919 + l_orderkey * 31) % 560 AS px, (l_orderkey * 104729 + l_suppkey * 13) % 560 AS py,
  20 + l_partkey % 40 AS w, 20 + l_orderkey % 40 AS h, l_orderkey % 100 AS lm,
  CAST(round(l_extendedprice * 100, 0) AS BIGINT) % 6300 AS cf, CASE WHEN l_linenumber % 2 = 0 THEN 640 ELSE 480 END AS st FROM lineitem),
det0 AS (SELECT CAST(det_id AS BIGINT) AS det_id, 'S' || s AS slide_id, CASE WHEN o = 0 THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END AS overlap_pct,
  CASE WHEN lm < 60 THEN 'Makrophage' WHEN lm < 90 THEN 'Lymphozyt' WHEN lm < 97 THEN 'NeutrophilerGranulozyt' ELSE 'EosinophilerGranulozyt' END AS label,
  0.37::DOUBLE + cf / 10000.0::DOUBLE AS confidence, CAST(px + tx * st AS BIGINT) AS x1, CAST(py + ty * st AS BIGINT) AS y1,
  CAST(px + w + tx * st AS BIGINT) AS x2, CAST(py + h + ty * st AS BIGINT) AS y2, CAST(tx * st AS BIGINT) AS x_correct, CAST(ty * st AS BIGINT) AS y_correct,
  CAST(tx AS BIGINT) AS tile_x, CAST(ty AS BIGINT) AS tile_y FROM b),
det AS MATERIALIZED (SELECT *, (x1 + x2) / 2.0::DOUBLE AS cx, (y1 + y2) / 2.0::DOUBLE AS cy FROM det0)"""
KEY = "slide_id, overlap_pct"
INNER = "x1 - x_correct > 5 AND y1 - y_correct > 5 AND x2 - x_correct < 635 AND y2 - y_correct < 635"


def real(x: str, digits: int = 6) -> str:
    """A real number as both engines hash it: rounded half up by the same arithmetic."""
    unit = f"1{'0' * digits}.0::DOUBLE"
    return f"(CASE WHEN isnan({x}) THEN 'nan'::DOUBLE ELSE floor(({x}) * {unit} + 0.5::DOUBLE) / {unit} END)"


def source(name: str, confidence: float = 0.44, where: str = "true") -> str:
    return f"""{name} AS MATERIALIZED (SELECT * FROM det WHERE confidence >= {confidence}::DOUBLE AND {where}),
{name}_r AS (SELECT {KEY}, label, coalesce(stddev_samp(((x2 - x1) + (y2 - y1)) / 2.0::DOUBLE), 0.0) AS sd FROM {name} GROUP BY ALL)"""


def edges(name: str, src: str, family: str, parameter: float) -> str:
    """Conflicts (k, v), k before v in priority, found by bins of 64 pixels."""
    x, y = ("x1", "y1") if family.startswith("iou") else ("cx", "cy")
    pairs = f"""SELECT a.det_id AS k, v.det_id AS v FROM (SELECT *, CAST(floor({x} / 64) AS BIGINT) AS gx, CAST(floor({y} / 64) AS BIGINT) AS gy FROM {src}) a
  JOIN (SELECT s.*, CAST(floor({x} / 64) AS BIGINT) + i AS gx, CAST(floor({y} / 64) AS BIGINT) + j AS gy FROM {src} s, (VALUES (-1), (0), (1)) t(i), (VALUES (-1), (0), (1)) u(j)) v
  ON a.slide_id = v.slide_id AND a.overlap_pct = v.overlap_pct AND a.gx = v.gx AND a.gy = v.gy"""
    before = "(a.confidence > v.confidence OR a.confidence = v.confidence AND a.det_id < v.det_id)"
    d2 = "(a.cx - v.cx) * (a.cx - v.cx) + (a.cy - v.cy) * (a.cy - v.cy)"
    if family.startswith("iou"):
        w, h = "greatest(least(a.x2, v.x2) - greatest(a.x1, v.x1), 0)", "greatest(least(a.y2, v.y2) - greatest(a.y1, v.y1), 0)"
        union = f"((a.x2 - a.x1) * (a.y2 - a.y1) + (v.x2 - v.x1) * (v.y2 - v.y1) - {w} * {h})"
        rule = f"CAST({w} * {h} AS DOUBLE) / {union} >= {parameter}::DOUBLE" + (" AND a.label = v.label" if family == "iou_classwise" else "")
    elif family == "nn_center":
        pairs += f" JOIN {src}_r r ON r.slide_id = a.slide_id AND r.overlap_pct = a.overlap_pct AND r.label = a.label"
        rule = f"a.label = v.label AND r.sd > 0 AND {d2} <= (r.sd * {parameter}) * (r.sd * {parameter})"
    else:
        rule = f"a.label = v.label AND {d2} <= {parameter} * {parameter}"
    return f"{name} AS MATERIALIZED ({pairs} WHERE {before} AND {rule})"


def nodes(name: str, src: str, scope: str) -> str:
    if scope == "global":
        place = f"SELECT det_id, 0::BIGINT AS place FROM {src}"
    elif scope == "grid_n1":
        place = f"SELECT det_id, tile_y * 1000000 + tile_x AS place FROM {src}"
    else:
        n = int(scope[-1])
        starts = f"generate_series(0, 3, {n - 1})"
        place = f"""SELECT det_id, y.o * 1000000 + x.o AS place FROM {src}, (SELECT unnest({starts}) AS o) x, (SELECT unnest({starts}) AS o) y
  WHERE tile_x BETWEEN x.o AND x.o + {n - 1} AND tile_y BETWEEN y.o AND y.o + {n - 1}"""
    return f"""{name} AS MATERIALIZED (SELECT det_id, place, lag(place) OVER w AS prev, lead(place) OVER w IS NULL AS last
  FROM ({place}) WINDOW w AS (PARTITION BY det_id ORDER BY place))"""


def greedy(name: str, src: str, family: str, scope: str, parameter: float) -> str:
    """Survivors (det_id) as a fixpoint over (detection, block)."""
    e, n = f"{name}_e", f"{name}_n"
    return f"""{edges(e, src, family, parameter)},
{nodes(n, src, scope)},
{name}_a AS MATERIALIZED (SELECT e.k, e.v, a.place FROM {e} e JOIN {n} a ON a.det_id = e.k),
{name}_k AS MATERIALIZED (SELECT a.k, a.place, a.v FROM {name}_a a SEMI JOIN {n} v ON v.det_id = a.v AND v.place = a.place),
{name}_f(det_id, place, s) USING KEY (det_id, place) AS (
  SELECT det_id, place, 0 FROM {n}
  UNION
  SELECT det_id, place, s FROM (
    SELECT n.det_id, n.place, CASE WHEN coalesce(bool_or(ks.s = 1), false) OR coalesce(any_value(pv.s) = 2, false) THEN 2
      WHEN coalesce(bool_and(ks.s = 2), true) AND (any_value(m.prev) IS NULL OR coalesce(any_value(pv.s) = 1, false)) THEN 1 ELSE 0 END AS s
    FROM (SELECT * FROM recurring.{name}_f WHERE s = 0) n JOIN {n} m ON m.det_id = n.det_id AND m.place = n.place
    LEFT JOIN {name}_k k ON k.v = n.det_id AND k.place = n.place
    LEFT JOIN recurring.{name}_f ks ON ks.det_id = k.k AND ks.place = k.place
    LEFT JOIN recurring.{name}_f pv ON pv.det_id = n.det_id AND pv.place = m.prev
    GROUP BY n.det_id, n.place) WHERE s <> 0),
{name} AS MATERIALIZED (SELECT f.det_id FROM {name}_f f JOIN {n} m ON m.det_id = f.det_id AND m.place = f.place WHERE f.s = 1 AND m.last)"""


def clusters(name: str, src: str, scope: str, radius: float) -> str:
    """First of each connected component, by the least priority number that reaches it; sliding blocks one after the other."""
    head = f"""{edges(name + "_e", src, "nn_cluster", radius)},
{name}_p AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY confidence DESC, det_id) AS p FROM {src}),
{name}_a AS MATERIALIZED (SELECT a.p AS x, a.tile_x AS xx, a.tile_y AS xy, e.v FROM {name}_e e JOIN {name}_p a ON a.det_id = e.k),
{name}_b AS MATERIALIZED (SELECT a.x, v.p AS y, a.xx, a.xy, v.tile_x AS yx, v.tile_y AS yy FROM {name}_a a JOIN {name}_p v ON v.det_id = a.v)"""
    if scope in ("global", "grid_n1"):
        steps = ["xx = yx AND xy = yy" if scope == "grid_n1" else "true"]
    else:
        n, steps = int(scope[-1]), []
        for by in range(0, 4, n - 1):
            for bx in range(0, 4, n - 1):
                steps.append(" AND ".join(f"{c} BETWEEN {o} AND {o + n - 1}" for c, o in (("xx", bx), ("yx", bx), ("xy", by), ("yy", by))))
    parts, dead = [head], f"SELECT 0::BIGINT AS p WHERE false"
    for k, inside in enumerate(steps):
        parts.append(f"""{name}_d{k} AS MATERIALIZED ({dead}),
{name}_h{k} AS MATERIALIZED (SELECT x, y FROM {name}_b WHERE {inside} AND x NOT IN (SELECT p FROM {name}_d{k}) AND y NOT IN (SELECT p FROM {name}_d{k})),
{name}_s{k} AS MATERIALIZED (SELECT x, y FROM {name}_h{k} UNION ALL SELECT y, x FROM {name}_h{k}),
{name}_f{k}(p, c) USING KEY (p) AS (
  SELECT DISTINCT x, x FROM {name}_s{k}
  UNION
  SELECT o.p, min(w.c) FROM {name}_f{k} w JOIN {name}_s{k} s ON s.x = w.p JOIN recurring.{name}_f{k} o ON o.p = s.y WHERE w.c < o.c GROUP BY o.p)""")
        dead = f"SELECT p FROM {name}_d{k} UNION ALL SELECT p FROM {name}_f{k} WHERE c <> p"
    return ",\n".join([*parts, f"{name} AS MATERIALIZED (SELECT det_id FROM {name}_p WHERE p NOT IN ({dead}))"])


PARAMETER = {"iou": "iou", "iou_edgecrop": "iou", "iou_classwise": "iou", "nn_dist": "distance", "nn_center": "center_k", "nn_cluster": "distance"}


def survivors(name: str, method: str, variant) -> str:
    """CTEs that end in ``name``: the survivors of a variant."""
    where = INNER if variant.family == "iou_edgecrop" else "true"
    src = f"{name}_src"
    head = source(src, variant.confidence, where)
    if variant.family == "none":
        return f"{head},\n{name} AS (SELECT det_id FROM {src})"
    value = getattr(variant, PARAMETER[variant.family])
    if variant.family == "nn_cluster":
        return f"{head},\n{clusters(name, src, variant.scope, value)}"
    return f"{head},\n{greedy(name, src, variant.family, variant.scope, value)}"


def query(ctes: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(x.strip() for x in ctes) + "\n" + select


def one_variant(method: str, variant) -> str:
    return query([DET, survivors("m", method, variant)], f"SELECT d.det_id, d.{KEY.replace(', ', ', d.')}, d.label, d.tile_x, d.tile_y FROM m JOIN det d USING (det_id)")


LABELS = "(VALUES " + ", ".join(f"('{x}')" for x in CONFIG.labels) + ") labels(label)"
METHOD_NAMES = "(VALUES " + ", ".join(f"('{m}')" for m in METHODS) + ") methods(nms_method)"


def _counted() -> list[str]:
    """CTEs for counts of the 31 variants: cells, tiles, blocks, eligible, one row a unit; e25 without edge cropping."""
    out = [DET]
    for k, (m, v) in enumerate(REGISTRY.items()):
        out.append(survivors(f"m{k}", m, v))
    union = " UNION ALL ".join(f"SELECT '{m}' AS nms_method, det_id FROM m{k}" for k, m in enumerate(REGISTRY))
    wide = ", ".join(f"CAST(count(*) FILTER (d.label = '{label}') AS BIGINT) AS {s}" for label, s in zip(CONFIG.labels, SHORT, strict=True))
    wide0 = ", ".join(f"CAST(coalesce(any_value(c.{s}), 0) AS BIGINT) AS {s}" for s in SHORT)
    sums = ", ".join(f"CAST(sum({s}) AS BIGINT) AS {s}" for s in SHORT)
    out += [
        f"surv AS MATERIALIZED ({union})",
        f"c0 AS (SELECT d.{KEY.replace(', ', ', d.')}, s.nms_method, {wide} FROM surv s JOIN det d USING (det_id) GROUP BY ALL)",
        f"cells AS MATERIALIZED (SELECT u.slide_id, u.overlap_pct, m.nms_method, {wide0} FROM (SELECT DISTINCT {KEY} FROM det) u CROSS JOIN {METHOD_NAMES.replace('methods', 'm')} "
        "LEFT JOIN c0 c ON c.slide_id = u.slide_id AND c.overlap_pct = u.overlap_pct AND c.nms_method = m.nms_method GROUP BY u.slide_id, u.overlap_pct, m.nms_method)",
        f"tiles AS MATERIALIZED (SELECT d.{KEY.replace(', ', ', d.')}, d.tile_x, d.tile_y, s.nms_method, {wide} FROM surv s JOIN det d USING (det_id) GROUP BY ALL)",
        f"blocks AS MATERIALIZED (SELECT *, Mac + Lym + Neu + Eos AS n_block_total FROM (SELECT {KEY}, n AS block_size, CASE WHEN n = 0 THEN 0 ELSE tile_x // greatest(n, 1) END AS block_x, "
        f"CASE WHEN n = 0 THEN 0 ELSE tile_y // greatest(n, 1) END AS block_y, nms_method, {sums} FROM tiles, (VALUES (1::BIGINT), (2), (3), (4), (5), (0)) sizes(n) GROUP BY ALL))",
        f"eligible AS MATERIALIZED (SELECT * FROM blocks SEMI JOIN (SELECT {KEY}, block_size, block_x, block_y FROM blocks WHERE nms_method = 'none' AND n_block_total >= {MIN_CELLS}) k USING ({KEY}, block_size, block_x, block_y))",
        "e25 AS (SELECT * FROM eligible WHERE nms_method NOT LIKE 'iou_edgecrop%')",
    ]
    return out


COUNTED = _counted()


def replaced(parts: list[str], strength: float = 0.5, fallback: bool = True) -> list[str]:
    """SQL of proportions with zeros replaced."""
    n, d = "(" + " + ".join(parts) + ")::DOUBLE", len(parts)
    zeros = "(" + " + ".join(f"({p} = 0)::INT" for p in parts) + ")"
    out = []
    for p in parts:
        degenerate = f"WHEN {zeros} * {strength}::DOUBLE / {n} >= 1 THEN ({p} + {strength}::DOUBLE) / ({n} + {strength * d}::DOUBLE) " if fallback else ""
        out.append(
            f"(CASE WHEN {n} = 0 THEN {1 / d}::DOUBLE WHEN {zeros} = 0 THEN {p}::DOUBLE / {n} {degenerate}"
            f"WHEN {p} = 0 THEN {strength}::DOUBLE / {n} ELSE {p}::DOUBLE / {n} * (1 - {zeros} * {strength}::DOUBLE / {n}) END)"
        )
    return out


def helmert(p: list[str]) -> list[str]:
    """SQL of the ilr coordinates of proportions."""
    from math import sqrt

    return [f"({sqrt(k / (k + 1))!r}::DOUBLE * ((" + " + ".join(f"ln({x})" for x in p[:k]) + f") / {float(k)}::DOUBLE - ln({p[k]})))" for k in range(1, len(p))]


def helmert_inverse(z: list[str]) -> list[str]:
    from math import sqrt

    d = len(z) + 1
    logs = []
    for part in range(d):
        terms = [f"{z[k - 1]} * {(sqrt(k / (k + 1)) / k if part < k else -sqrt(k / (k + 1)))!r}::DOUBLE" for k in range(max(part, 1), d)]
        logs.append("exp(" + " + ".join(terms) + ")")
    return [f"({x} / ({' + '.join(logs)}))" for x in logs]


PARTS = replaced(list(SHORT))
RATIOS = (
    "ratios AS MATERIALIZED (SELECT *, ln(p0 / p1) AS alr_Mac, ln(p2 / p1) AS alr_Neu, ln(p3 / p1) AS alr_Eos, "
    + ", ".join(f"{z} AS ilr_{k}" for k, z in enumerate(helmert(["p0", "p1", "p2", "p3"]), 1))
    + " FROM (SELECT *, "
    + ", ".join(f"{p} AS p{k}" for k, p in enumerate(PARTS))
    + " FROM cells WHERE Mac + Lym + Neu + Eos > 0))"
)
LONG_ALR = "alr AS (" + " UNION ALL ".join(f"SELECT {KEY}, nms_method, '{c}' AS coord, {c} AS value FROM ratios" for c in ("alr_Mac", "alr_Neu", "alr_Eos")) + ")"
LONG_ILR = "lilr AS (" + " UNION ALL ".join(f"SELECT {KEY}, nms_method, 'ilr_{k}' AS coord, round(ilr_{k}, 9) AS value FROM ratios WHERE nms_method NOT LIKE 'iou_edgecrop%'" for k in (1, 2, 3)) + ")"
DIFFS = f"diffs AS (SELECT a.{KEY.replace(', ', ', a.')}, a.nms_method, a.coord, a.value - b.value AS diff FROM alr a JOIN alr b ON a.slide_id = b.slide_id AND a.overlap_pct = b.overlap_pct AND a.coord = b.coord AND b.nms_method = 'none' WHERE a.nms_method <> 'none')"
ON_CELLS = [*COUNTED, RATIOS, LONG_ALR, LONG_ILR, DIFFS]
BLOCK = f"{KEY}, block_size, block_x, block_y"


def long(table: str, keys: str, more: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{label}' AS label, {s} AS count{more.format(s=s)} FROM {table}" for label, s in zip(CONFIG.labels, SHORT, strict=True))


def panel(regime: str = "as_is") -> str:
    parts = [f"{s}::DOUBLE" for s in SHORT]
    if regime == "no_eos":
        parts = parts[:-1]
    if regime == "common_scale":
        n = "(" + " + ".join(parts) + ")"
        parts = [f"(CASE WHEN {n} > 0 THEN {p} / {n} * 1000.0::DOUBLE ELSE 0.0::DOUBLE END)" for p in parts]
    names = [f"q{k}" for k in range(len(parts))]
    z = helmert([f"p{k}" for k in range(len(parts))])
    inner = f"SELECT {BLOCK}, nms_method, {', '.join(f'{p} AS {n}' for p, n in zip(parts, names, strict=True))} FROM e25"
    middle = f"SELECT *, {', '.join(f'{p} AS p{k}' for k, p in enumerate(replaced(names)))} FROM ({inner})"
    return f"SELECT {BLOCK}, nms_method, {', '.join(f'{x} AS z{k}' for k, x in enumerate(z, 1))} FROM ({middle})"


def alpha(regime: str = "as_is") -> str:
    """Alpha per setting, over all coordinates and for each."""
    z = ["z1", "z2"] if regime == "no_eos" else ["z1", "z2", "z3"]
    m = len(METHODS_25)
    pairs = m * (m - 1) / 2
    unit = ", ".join([f"sum({c}) AS s_{c}, sum({c} * {c}) AS q_{c}, ({m} * sum({c} * {c}) - sum({c}) * sum({c})) / {pairs}::DOUBLE AS d_{c}" for c in z])

    def value(cs):
        d, q, s = (" + ".join(f"sum({p}_{c})" + (f" * sum(s_{c})" if p == "s" else "") for c in cs) for p in "dqs")
        n = f"(count(*) * {m})::DOUBLE"
        expected = f"((2 * {n} * ({q}) - 2 * ({s})) / ({n} * ({n} - 1)))"
        return f"CASE WHEN count(*) < 2 THEN 'nan'::DOUBLE WHEN {expected} > 0 THEN 1 - ({d}) / count(*) / {expected} WHEN ({d}) <= 0 THEN 1.0 ELSE 'nan'::DOUBLE END"

    each = ", ".join(f"{real(value([c]))} AS alpha_coord_{k}" for k, c in enumerate(z, 1))
    units = f"SELECT {BLOCK}, {unit} FROM ({panel(regime)}) GROUP BY {BLOCK} HAVING count(*) = {m}"
    return f"SELECT block_size, overlap_pct, count(*) AS n_blocks, {real(value(z))} AS alpha, {each} FROM ({units}) GROUP BY block_size, overlap_pct"


def swept(variants: dict, cells: str = "cells", prefix: str = "w") -> list[str]:
    """CTEs for the survivors' counts of parameter settings, one row a slide, overlap and setting, and log-ratio differences."""
    wide = ", ".join(f"CAST(count(*) FILTER (d.label = '{label}') AS BIGINT) AS {s}" for label, s in zip(CONFIG.labels, SHORT, strict=True))
    union = " UNION ALL ".join(f"SELECT '{n}' AS nms_method, det_id FROM {prefix}{k}" for k, n in enumerate(variants))
    if cells != "cells":  # beside the counts of the registered variants
        return [*(survivors(f"{prefix}{k}", n, v) for k, (n, v) in enumerate(variants.items())), f"{cells} AS MATERIALIZED (SELECT d.{KEY.replace(', ', ', d.')}, s.nms_method, {wide} FROM ({union}) s JOIN det d USING (det_id) GROUP BY ALL)"]
    return [
        DET,
        *(survivors(f"{prefix}{k}", n, v) for k, (n, v) in enumerate(variants.items())),
        f"{cells} AS MATERIALIZED (SELECT d.{KEY.replace(', ', ', d.')}, s.nms_method, {wide} FROM ({union}) s JOIN det d USING (det_id) GROUP BY ALL)",
        RATIOS,
        LONG_ALR,
    ]


def differences(name: str, reference: str, ratios: str = "alr", more: str = "") -> str:
    """CTE of each method's log-ratios minus the reference's, by slide; ``more`` names further keys."""
    keys = [*KEY.split(", "), "coord", *more.split()]
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    return f"{name} AS (SELECT {', '.join(f'a.{k}' for k in keys)}, a.nms_method, a.value - b.value AS diff FROM {ratios} a JOIN {ratios} b ON {on} AND b.nms_method = '{reference}' WHERE a.nms_method <> '{reference}')"


def draws(name: str, sizes: str) -> str:
    """CTE (n, r, k, pick) of the draws for each n of a table."""
    rows = f"SELECT n, r, unnest(range(n)) AS k FROM (SELECT DISTINCT n::BIGINT AS n FROM {sizes} WHERE n > 0) CROSS JOIN (SELECT unnest(range({CONFIG.draws})) AS r)"
    for step, text in resampling.steps():
        rows = f"SELECT *, {text} AS {step} FROM ({rows})"
    return f"{name} AS MATERIALIZED (SELECT n, r, k, x6 % n AS pick FROM ({rows}))"


def permutation(most: int = 4) -> list[str]:
    """CTEs for ``wy``: family-wise p-values from ``tail`` and ``flags``; up to ``most`` slots a block, or all of them."""
    sets = []
    for t in range(1, most + 1):
        js = ", ".join(f"j{i}" for i in range(t))
        inner = "SELECT m FROM sizes"
        for i in range(t):
            inner = f"SELECT *, unnest(range({'j%d + 1' % (i - 1) if i else '0'}, m)) AS j{i} FROM ({inner})"
        sets.append(f"SELECT m, {t} AS t, row_number() OVER (PARTITION BY m ORDER BY {js}) - 1 AS no, [{js}] AS js FROM ({inner})")
    rows = f"SELECT *, unnest(range(nb)) AS k FROM (SELECT h.*, c.sets FROM hist h JOIN setsizes c ON c.m = h.m AND c.t = h.t WHERE h.t < h.m) CROSS JOIN (SELECT unnest(range({CONFIG.draws})) AS r)"
    for step, text in resampling.steps():
        rows = f"SELECT *, {text} AS {step} FROM ({rows})"
    return [
        "ms AS (SELECT block_size, overlap_pct, count(*) AS m FROM flags GROUP BY ALL)",
        "sizes AS (SELECT DISTINCT m FROM ms)",
        f"sets AS MATERIALIZED ({' UNION ALL '.join(sets)})",
        "setsizes AS (SELECT m, t, count(*) AS sets FROM sets GROUP BY m, t)",
        "slots AS (SELECT block_size, overlap_pct, b, CAST(sum(in_tail::INT) AS BIGINT) AS t FROM tail GROUP BY ALL HAVING sum(in_tail::INT) > 0)",
        "hist AS MATERIALIZED (SELECT block_size, overlap_pct, t, nb, m FROM (SELECT block_size, overlap_pct, t, count(*) AS nb FROM slots GROUP BY ALL) JOIN ms USING (block_size, overlap_pct))",
        f"drawn AS MATERIALIZED (SELECT block_size, overlap_pct, r, m, t, x6 % sets AS no, count(*) AS n FROM ({rows}) GROUP BY ALL)",
        "got AS (SELECT block_size, overlap_pct, r, j, sum(n) AS n FROM (SELECT d.block_size, d.overlap_pct, d.r, d.n, unnest(s.js) AS j FROM drawn d JOIN sets s ON s.m = d.m AND s.t = d.t AND s.no = d.no) GROUP BY ALL)",
        "most AS (SELECT block_size, overlap_pct, r, max(n) AS most FROM got GROUP BY ALL)",
        "full_ AS (SELECT block_size, overlap_pct, coalesce(sum(nb) FILTER (t >= m), 0) AS full_ FROM hist GROUP BY ALL)",
        f"tops AS MATERIALIZED (SELECT f.block_size, f.overlap_pct, f.full_ + coalesce(x.most, 0) AS top FROM full_ f CROSS JOIN (SELECT unnest(range({CONFIG.draws})) AS r) q LEFT JOIN most x ON x.block_size = f.block_size AND x.overlap_pct = f.overlap_pct AND x.r = q.r)",
        f"beaten AS (SELECT f.block_size, f.overlap_pct, f.nms_method, count(t.top) AS made, count(*) FILTER (t.top >= f.n_upper) AS beats FROM flags f LEFT JOIN tops t USING (block_size, overlap_pct) GROUP BY ALL)",
        f"wy AS (SELECT f.*, f.n_upper::DOUBLE / f.n_blocks AS frac_upper_tail, (sum(f.n_upper) OVER s)::DOUBLE / sum(f.n_blocks) OVER s AS expected_frac, CASE WHEN made = 0 THEN 1.0 ELSE (1 + beats) / {CONFIG.draws + 1}.0::DOUBLE END AS p_value, "
        f"CASE WHEN made = 0 THEN 1.0 ELSE (1 + beats) / {CONFIG.draws + 1}.0::DOUBLE END < {CONFIG.alpha}::DOUBLE AS flagged_outlier FROM flags f JOIN beaten USING (block_size, overlap_pct, nms_method) WINDOW s AS (PARTITION BY block_size, overlap_pct))",
    ]


def intervals(name: str, source: str, keys: str, margin: float = CONFIG.margin) -> list[str]:
    """CTEs that end in ``name``: n, median, interval of resampled medians of ``diff``, and the verdict, by keys."""
    g, d, m, b, c = (f"{name}_{x}" for x in "gdmbc")
    nan = "'nan'::DOUBLE"
    return [
        f"{g} AS MATERIALIZED (SELECT {keys}, count(diff) FILTER (NOT isnan(diff)) AS n, list_sort(list(diff) FILTER (NOT isnan(diff))) AS v FROM {source} GROUP BY {keys})",
        draws(d, g),
        f"{m} AS MATERIALIZED (SELECT n, low, high, r FROM (SELECT n, r, list_sort(list(pick)) AS s FROM {d} GROUP BY n, r) t, LATERAL (SELECT s[(n - 1) // 2 + 1] AS low, s[n // 2 + 1] AS high))",
        f"{b} AS (SELECT {', '.join(f'g.{k.strip()}' for k in keys.split(','))}, (g.v[m.low + 1] + g.v[m.high + 1]) / 2.0::DOUBLE AS made FROM {g} g JOIN {m} m ON m.n = g.n WHERE g.n >= 3)",
        f"{c} AS MATERIALIZED (SELECT {keys}, quantile_cont(made, 0.05) AS low, quantile_cont(made, 0.95) AS high FROM {b} GROUP BY {keys})",
        f"{name} AS (SELECT {keys}, n, CASE WHEN n >= 3 THEN (v[(n - 1) // 2 + 1] + v[n // 2 + 1]) / 2.0::DOUBLE ELSE {nan} END AS median, coalesce(low, {nan}) AS ci_low, coalesce(high, {nan}) AS ci_high, "
        f"coalesce(low > -{margin}::DOUBLE AND high < {margin}::DOUBLE, false) AS equivalent FROM {g} LEFT JOIN {c} USING ({keys}))",
    ]


def slide_bootstrap() -> list[str]:
    """CTEs for ``curve``: alpha, its interval over slides drawn anew, and the blocks used, per setting."""
    m, z = len(METHODS_25), ["z1", "z2", "z3"]
    pairs = m * (m - 1) / 2
    unit = ", ".join(f"sum({c}) AS s_{c}, sum({c} * {c}) AS q_{c}, ({m} * sum({c} * {c}) - sum({c}) * sum({c})) / {pairs}::DOUBLE AS d_{c}" for c in z)
    sums = "count(*)::DOUBLE AS blocks, " + ", ".join(f"sum({' + '.join(f'{p}_{c}' for c in z)}) AS {p}" for p in "dq") + ", " + ", ".join(f"sum(s_{c}) AS s_{c}" for c in z)
    parts = ["blocks", "d", "q", *(f"s_{c}" for c in z)]
    n = f"(blocks * {m})"
    expected = f"((2 * {n} * q - 2 * ({' + '.join(f's_{c} * s_{c}' for c in z)})) / ({n} * ({n} - 1)))"
    value = f"CASE WHEN blocks < 2 THEN 'nan'::DOUBLE WHEN {expected} > 0 THEN 1 - d / blocks / {expected} WHEN d <= 0 THEN 1.0 ELSE 'nan'::DOUBLE END"
    return [
        f"bu AS MATERIALIZED (SELECT {BLOCK}, {unit} FROM ({panel()}) GROUP BY {BLOCK} HAVING count(*) = {m})",
        f"bs AS MATERIALIZED (SELECT block_size, overlap_pct, slide_id, row_number() OVER (PARTITION BY block_size, overlap_pct ORDER BY slide_id) - 1 AS pick, count(*) OVER (PARTITION BY block_size, overlap_pct) AS n, {sums} FROM bu GROUP BY block_size, overlap_pct, slide_id)",
        draws("bd", "bs"),
        "bw AS MATERIALIZED (SELECT n, r, pick, count(*) AS w FROM bd GROUP BY n, r, pick)",
        f"br AS (SELECT s.block_size, s.overlap_pct, w.r, {', '.join(f'sum(s.{c} * w.w) AS {c}' for c in parts)} FROM bs s JOIN bw w ON w.n = s.n AND w.pick = s.pick GROUP BY s.block_size, s.overlap_pct, w.r)",
        f"bq AS (SELECT block_size, overlap_pct, coalesce(quantile_cont(value, 0.025) FILTER (NOT isnan(value)), 'nan'::DOUBLE) AS lo95, coalesce(quantile_cont(value, 0.975) FILTER (NOT isnan(value)), 'nan'::DOUBLE) AS hi95 FROM (SELECT block_size, overlap_pct, {value} AS value FROM br) GROUP BY block_size, overlap_pct)",
        f"curve AS (SELECT block_size, overlap_pct, {value} AS alpha, lo95, hi95, CAST(blocks AS BIGINT) AS n_blocks_used FROM (SELECT block_size, overlap_pct, {', '.join(f'sum({c}) AS {c}' for c in parts)} FROM bs GROUP BY block_size, overlap_pct) JOIN bq USING (block_size, overlap_pct))",
    ]


def _deviations() -> list[str]:
    """CTEs for Weiszfeld's iteration, block by block, and the distances of ``dev`` (aitchison, mahalanobis) to it."""
    gap = "sqrt(" + " + ".join(f"(p.z{k} - w.y{k}) * (p.z{k} - w.y{k})" for k in (1, 2, 3)) + ")"
    step = "sqrt(" + " + ".join(f"(n{k} - y{k}) * (n{k} - y{k})" for k in (1, 2, 3)) + ")"
    means = ", ".join(f"sum(z{k} / away) / sum(1.0::DOUBLE / away) AS n{k}" for k in (1, 2, 3))
    pairs = [(i, j) for i in (1, 2, 3) for j in range(i, 4)]
    cross = ", ".join(f"sum(d{i} * d{j}) OVER b AS x{i}{j}" for i, j in pairs)
    cov = ", ".join(f"(x{i}{j} - m::DOUBLE / (m - 1) * d{i} * d{j}) / (m - 2) AS v{i}{j}" for i, j in pairs)
    a = {(i, j): f"(v{min(i, j)}{max(i, j)}" + (" + e)" if i == j else ")") for i in (1, 2, 3) for j in (1, 2, 3)}
    minor = lambda i, j, k, l: f"({a[i, k]} * {a[j, l]} - {a[i, l]} * {a[j, k]})"  # noqa: E731  rows i, j; columns k, l
    det = f"({a[1, 1]} * {minor(2, 3, 2, 3)} - {a[1, 2]} * {minor(2, 3, 1, 3)} + {a[1, 3]} * {minor(2, 3, 1, 2)})"
    quad = (
        f"(g1 * g1 * {minor(2, 3, 2, 3)} + g2 * g2 * {minor(1, 3, 1, 3)} + g3 * g3 * {minor(1, 2, 1, 2)} - 2 * g1 * g2 * {minor(2, 3, 1, 3)}"
        f" + 2 * g1 * g3 * {minor(2, 3, 1, 2)} - 2 * g2 * g3 * {minor(1, 3, 1, 2)})"
    )
    return [
        f"pts AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY {BLOCK}) AS b FROM ({panel()}))",
        f"""wz(b, r, y1, y2, y3, moved) AS (
  SELECT b, 0, median(z1), median(z2), median(z3), 1.0::DOUBLE FROM pts GROUP BY b HAVING count(*) > 1
  UNION ALL
  SELECT b, r + 1, n1, n2, n3, {step} FROM (
    SELECT b, r, y1, y2, y3, {means} FROM (SELECT w.*, p.z1, p.z2, p.z3, {gap} AS away FROM wz w JOIN pts p ON p.b = w.b WHERE w.moved >= 1e-7::DOUBLE AND w.r < 200)
    WHERE away > 1e-12::DOUBLE GROUP BY b, r, y1, y2, y3))""",
        "center AS MATERIALIZED (SELECT b, arg_max(y1, r) AS y1, arg_max(y2, r) AS y2, arg_max(y3, r) AS y3 FROM wz GROUP BY b)",
        f"""dev AS MATERIALIZED (SELECT {BLOCK}, nms_method, b, m, y1, y2, y3, aitchison,
  CASE WHEN m <= 4 THEN aitchison ELSE sqrt(greatest(0.0::DOUBLE, {quad} / {det})) END AS mahalanobis FROM (
  SELECT *, 1e-3::DOUBLE * greatest((v11 + v22 + v33) / 3, 0.0::DOUBLE) + 1e-6::DOUBLE AS e FROM (
  SELECT *, {cov} FROM (SELECT *, {cross} FROM (
  SELECT p.*, c.y1, c.y2, c.y3, p.z1 - c.y1 AS g1, p.z2 - c.y2 AS g2, p.z3 - c.y3 AS g3, count(*) OVER w AS m,
    p.z1 - avg(p.z1) OVER w AS d1, p.z2 - avg(p.z2) OVER w AS d2, p.z3 - avg(p.z3) OVER w AS d3,
    sqrt((p.z1 - c.y1) * (p.z1 - c.y1) + (p.z2 - c.y2) * (p.z2 - c.y2) + (p.z3 - c.y3) * (p.z3 - c.y3)) AS aitchison
  FROM pts p JOIN center c ON c.b = p.b WINDOW w AS (PARTITION BY p.b)) WINDOW b AS (PARTITION BY b)))))""",
    ]


DEVIATIONS = [*COUNTED, *_deviations()]
