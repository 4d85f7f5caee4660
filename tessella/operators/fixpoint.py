"""Every suppression rule by joins, for groups too large for one task.

A node is a detection in one block; blocks are visited in order. A killer edge joins a node to one of higher priority
in its block that conflicts with it, a previous edge to the same detection in its block before. A node is dead if a
killer lives or its previous node is dead, and lives once its previous node lives and all killers are dead. Variants are bits of
a node's state, so all of one scope share a loop. Each round is a few joins on the undecided nodes only, ended by a written table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import kernels, suppress
from tessella.operators import stream as streams
from tessella.operators.components import stars
from tessella.sources.scratch import cut, discard


#: Side of a block, in cells: of a radius, or of the boxes' level. Rows of whole blocks that are looked at together, and of a batch of conflicts.
BLOCK, BOX_BLOCK = 8, 4
ROOM, BATCH = 196_608, 65_536


def _dealt(rows: DataFrame, side: Column, reach: Column, home: Column) -> DataFrame:
    """Rows by block (bx, by) of centres px, py, ``own`` where a row is at home; ``home`` tells which rows have one there.

    A row at home visits the blocks ahead within ``reach`` of it, others all blocks within reach. So two rows at home meet in
    one block only, and a visitor meets each row that it may reach there.
    """
    reach = reach * (1 + 1e-9)
    at = lambda c, by=0: F.floor((F.col(c) + by) / side)
    rows = rows.withColumns({"hx": F.when(home, at("px")), "hy": F.when(home, at("py"))})
    for c in "xy":
        rows = rows.withColumn(f"b{c}", F.explode(F.sequence(at(f"p{c}", -reach), at(f"p{c}", reach))))
    rows = rows.where("hx is null or bx > hx or bx = hx and by >= hy")
    return rows.withColumn("own", F.coalesce((F.col("bx") == F.col("hx")) & (F.col("by") == F.col("hy")), F.lit(False))).drop("hx", "hy", "px", "py")


def _conflicts(rows: DataFrame, keys: list[str], make, overlap: bool = False) -> DataFrame:
    """Conflicts (killer, victim) of the rows at home in a block with one another and with its visitors.

    A task holds some whole blocks, never their conflicts: these leave it batch by batch. ``make`` has the kernel's rule for a dict of columns.
    """
    names = [c for c in rows.columns if c not in keys]

    def parts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            code = table[k].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        return np.cumsum(new) - 1

    def found(table: pa.Table, part: np.ndarray) -> Iterator[tuple]:
        c = {name: table[name].to_numpy() for name in names}
        near, own, first, det = make(c), c["own"], c["confidence"], c["det_id"]
        first = np.where(np.isnan(first), np.inf, first)
        for i, j in kernels.meetings(near, part, own):
            some = (first[i] != first[j]) | (det[i] != det[j])  # a row does not meet its like
            i, j = i[some], j[some]
            before = (first[i] > first[j]) | (first[i] == first[j]) & (det[i] < det[j])
            yield np.where(before, det[i], det[j]), np.where(before, det[j], det[i]), *([kernels.iou(near.boxes[i], near.boxes[j])] if overlap else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for table in blocks(batches):
            for columns in found(table, parts(table)):
                out.append(columns)
                n += len(columns[0])
                if n >= BATCH:
                    yield batch(out)
                    out, n = [], 0
        if n:
            yield batch(out)

    def batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)) for a in zip(*out, strict=True)], ["killer", "victim", *(["iou"] if overlap else [])])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n, room = [], 0, ROOM
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= room:
                table = pa.Table.from_batches(held)
                part = parts(table)
                whole = int(np.searchsorted(part, part[-1]))  # the last block may go on
                room = ROOM if whole else 2 * n
                if whole:
                    yield table.slice(0, whole)
                    held, n = table.slice(whole).to_batches(), n - whole
        if n:
            yield pa.Table.from_batches(held)

    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as their bytes don't tell how many conflicts blocks have
    rows = rows.repartition(usual, *keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, f"killer long, victim long{', iou double' if overlap else ''}")


FINITE = float("inf")


def disk_edges(dets: DataFrame, reach: Column, keys: list[str]) -> DataFrame:
    """Conflicts (killer, victim) of equal keys whose centres are at most ``reach`` apart, which is one for rows of equal keys."""
    rows = dets.withColumn("reach", reach.cast("double")).where("reach > 0 and confidence is not null").dropna(subset=[*keys, "det_id"])
    rows = rows.where((F.abs("cx") < FINITE) & (F.abs("cy") < FINITE))
    rows = rows.select(*keys, F.col("det_id").cast("long"), F.col("confidence").cast("double"), *(F.col(c).cast("double") for c in ("cx", "cy")), "reach", F.col("cx").alias("px"), F.col("cy").alias("py"))
    rows = _dealt(rows, F.col("reach") * BLOCK, F.col("reach"), F.lit(True))
    return _conflicts(rows, [*keys, "bx", "by"], lambda c: kernels.Disks(c["cx"], c["cy"], np.zeros(len(c["cx"]), np.int64), c["reach"]))


def iou_edges(dets: DataFrame, threshold: float, keys=("slide_id", "overlap_pct")) -> DataFrame:
    """Conflicts (killer, victim, iou) by box overlap.

    Boxes are dealt to levels by their larger side, below a power of two. Those of a level are at home on its blocks, where
    narrower boxes visit them from as many levels as the threshold allows. Centres of conflicting boxes are apart by
    less than the wider one's sides times (1 - threshold).
    """
    apart, keys = kernels.levels_apart(threshold), list(keys)
    corners = ["x1", "y1", "x2", "y2"]
    rows = dets.where("x2 > x1 and y2 > y1 and confidence is not null").dropna(subset=[*keys, "det_id"])  # others overlap nothing
    own = F.length(F.bin(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).cast("long")))
    rows = rows.select(*keys, F.col("det_id").cast("long"), F.col("confidence").cast("double"), *corners, own.alias("mine"), *(((F.col(f"{c}1") + F.col(f"{c}2")) / 2.0).alias(f"p{c}") for c in "xy"))
    if apart:  # only levels that the data have
        known = rows.select(*keys, F.col("mine").alias("level")).distinct()
        rows = rows.join(F.broadcast(known), keys).where((F.col("level") >= F.col("mine")) & (F.col("level") <= F.col("mine") + apart))
    else:
        rows = rows.withColumn("level", F.col("mine"))
    side = F.pow(F.lit(2.0), "level")
    rows = _dealt(rows, side * BOX_BLOCK, side * max(1 - threshold, 0.0) + 1, F.col("level") == F.col("mine")).drop("mine")
    edges = _conflicts(rows, [*keys, "level", "bx", "by"], lambda c: kernels.Boxes(np.stack([c[k] for k in corners], axis=1), threshold), overlap=True)
    return edges.withColumn("iou", F.round("iou", 9))


def distance_edges(dets: DataFrame, radius: float, keys=("slide_id", "overlap_pct", "label")) -> DataFrame:
    return disk_edges(dets, F.lit(radius), list(keys))


def center_edges(dets: DataFrame, k: float, keys=("slide_id", "overlap_pct", "label")) -> DataFrame:
    """Conflicts by centre distance within the label's radius, k standard deviations of its box sides."""
    radii = suppress.center_radii(dets, k)  # a row a slide, overlap and label
    return disk_edges(dets.join(radii, ["slide_id", "overlap_pct", "label"]), F.col("radius"), list(keys))


def nodes(dets: DataFrame, scope: str) -> DataFrame:
    """(det_id, place): the blocks of each detection, numbered in the order of visit inside a slide and overlap."""
    if scope == "global":
        return dets.select("det_id", F.lit(0).cast("long").alias("place"))
    if scope == "grid_n1":
        return dets.select("det_id", (F.col("tile_y") * 1_000_000 + F.col("tile_x")).cast("long").alias("place"))
    n = int(scope[-1])

    def origins(tile):  # multiples of n - 1 from which a block of n tiles covers this one
        low = F.greatest(F.ceil((F.col(tile) - (n - 1)) / F.lit(float(n - 1))), F.lit(0))
        return F.sequence(low.cast("long"), F.floor(F.col(tile) / F.lit(float(n - 1))).cast("long"))

    rows = dets.select("det_id", "tile_x", F.explode(origins("tile_y")).alias("by"))
    rows = rows.select("det_id", "by", F.explode(origins("tile_x")).alias("bx"))
    return rows.select("det_id", (F.col("by") * 1_000_000 + F.col("bx")).alias("place"))


def dead_bits(took: DataFrame, edges: DataFrame, scope: str) -> DataFrame:
    """(det_id, dead): the variants, as bits, in which greedy suppression along the edges removes a detection.

    ``took`` (det_id, tile_x, tile_y, took) has the variants that a detection takes part in, ``edges`` (killer, victim, bits)
    those in which two detections conflict. All variants of a scope share its nodes and are settled by one loop.
    """
    edges = cut(edges.select("killer", "victim", "bits"), "fixpoint-conflicts")
    involved = edges.select(F.explode(F.array("killer", "victim")).alias("det_id")).distinct()
    some = cut(took.select("det_id", "tile_x", "tile_y", "took").join(involved, "det_id", "left_semi"), "fixpoint-involved")
    at = nodes(some, scope)
    order = Window.partitionBy("det_id").orderBy("place")
    state = at.withColumn("before", F.lag("place").over(order)).withColumn("last", F.lead("place").over(order).isNull())
    none = F.lit(0).cast("long")
    state = cut(state.join(some.select("det_id", "took"), "det_id").withColumns({"alive": none, "dead": none}), "fixpoint-state")
    here = at.select(F.col("det_id").alias("killer"), "place")
    kills = edges.join(here, "killer").join(at.withColumnRenamed("det_id", "victim"), ["victim", "place"])
    kills = cut(kills, "fixpoint-edges")
    both = lambda x, y: F.col(x).bitwiseAND(F.col(y))
    out = lambda x: F.bitwise_not(F.col(x))
    undecided = both("took", "alive").bitwiseOR(both("took", "dead")) != F.col("took")
    while not state.where(undecided).isEmpty():
        known = state.select(F.col("det_id").alias("d"), F.col("place").alias("p"), F.col("alive").alias("lives"), F.col("dead").alias("died"))
        open_ = state.where(undecided)
        mine = kills.join(open_.select(F.col("det_id").alias("victim"), "place"), ["victim", "place"])
        above = mine.join(known, (F.col("killer") == F.col("d")) & (F.col("place") == F.col("p"))).groupBy("victim", "place").agg(
            F.bit_or(both("bits", "lives")).alias("killed"), F.bit_or(F.col("bits").bitwiseAND(out("lives")).bitwiseAND(out("died"))).alias("waits")
        )
        above = above.select(F.col("victim").alias("v"), F.col("place").alias("q"), "killed", "waits")
        step = open_.join(above, (F.col("det_id") == F.col("v")) & (F.col("place") == F.col("q")), "left").drop("v", "q")
        step = step.join(known, (F.col("det_id") == F.col("d")) & (F.col("before") == F.col("p")), "left")
        step = step.withColumns({"killed": F.coalesce("killed", none), "waits": F.coalesce("waits", none), "died": F.coalesce("died", none), "lives": F.coalesce("lives", F.lit(-1).cast("long"))})
        dead = F.col("took").bitwiseAND(F.col("dead").bitwiseOR(F.col("killed")).bitwiseOR(F.col("died")))
        step = step.withColumn("dead", dead)
        free = both("took", "lives").bitwiseAND(out("waits")).bitwiseAND(out("dead"))
        step = step.select("det_id", "place", "before", "last", "took", F.col("alive").bitwiseOR(free).alias("alive"), "dead")
        following = cut(state.where(~undecided).unionByName(step), "fixpoint-state")
        discard(state)
        state = following
    discard(edges, some, kills)
    return state.where("last and dead != 0").select("det_id", "dead")


def survivors(dets: DataFrame, edges: DataFrame, scope: str) -> DataFrame:
    """det_id of the survivors of greedy suppression along ``edges`` (killer, victim)."""
    one = F.lit(1).cast("long")
    dead = dead_bits(dets.withColumn("took", one), edges.withColumn("bits", one), scope)
    return dets.select("det_id").join(dead, "det_id", "left_anti")


def cluster_dead(dets: DataFrame, edges: DataFrame, scope: str) -> DataFrame:
    """det_id of all but the first of each connected component along ``edges``, inside each block, blocks in their order.

    Blocks that can share a detection differ in bx + 2 by, so all blocks of equal bx + 2 by are solved at once and a
    slide takes a round for each such value, whatever its number of blocks.
    """
    edges = cut(edges.select("killer", "victim"), "cluster-conflicts")
    involved = edges.select(F.explode(F.array("killer", "victim")).alias("det_id")).distinct()
    some = cut(dets.select("det_id", "tile_x", "tile_y", "confidence").join(involved, "det_id", "left_semi"), "cluster-involved")
    at = nodes(some, scope)
    here = at.select(F.col("det_id").alias("killer"), "place")
    pairs = edges.join(here, "killer").join(at.withColumnRenamed("det_id", "victim"), ["victim", "place"])
    wave = F.expr("place % 1000000 + 2 * (place div 1000000)") if scope.startswith("grid") and scope != "grid_n1" else F.lit(0).cast("long")
    pairs = cut(pairs.select("killer", "victim", wave.alias("wave")), "cluster-pairs")
    gone = cut(at.limit(0).select("det_id"), "cluster-gone")
    for (t,) in sorted(map(tuple, pairs.select("wave").distinct().collect())):  # blocks across plus twice blocks down at most
        mine = pairs.where(F.col("wave") == t)
        for end in ("killer", "victim"):
            mine = mine.join(gone.withColumnRenamed("det_id", end), end, "left_anti")
        to = stars(mine.select(F.col("killer").alias("u"), F.col("victim").alias("v")))
        members = to.select(F.col("u").alias("det_id"), "v").unionByName(to.select(F.col("v").alias("det_id"), "v")).distinct()
        members = members.join(some.select("det_id", "confidence"), "det_id")
        first = F.min(F.struct((-F.col("confidence")).alias("c"), "det_id")).over(Window.partitionBy("v"))
        dead = members.withColumn("first", first).where(F.col("det_id") != F.col("first.det_id")).select("det_id")
        following = cut(gone.unionByName(dead), "cluster-gone")
        discard(gone, to)
        gone = following
    discard(edges, some, pairs)
    return gone


def _graph(v: suppress.Variant) -> tuple:
    """What a variant's conflicts depend on; variants with one key share a table of edges."""
    if v.family in ("iou", "iou_edgecrop", "iou_classwise"):
        return ("iou_classwise" if v.family == "iou_classwise" else "iou", v.iou)
    return ("center", v.center_k, v.confidence) if v.family == "nn_center" else ("distance", v.distance)


def _graph_edges(dets: DataFrame, key: tuple) -> DataFrame:
    if key[0].startswith("iou"):
        return iou_edges(dets, key[1], ("slide_id", "overlap_pct", *(("label",) if key[0] == "iou_classwise" else ())))
    return center_edges(dets, key[1]) if key[0] == "center" else distance_edges(dets, key[1])


def masks(dets: DataFrame, variants: dict[str, suppress.Variant], isolate: bool = False) -> DataFrame:
    """Each detection with its mask of survived variants, as the grouped pass has it.

    Conflicts are found once for each rule and parameter, whatever the number of scopes and variants that use them, and
    the greedy variants of a scope are settled together, a bit each; clusters take a loop a variant.
    """
    bit = {name: 1 << k for k, name in enumerate(variants)}
    bits = lambda names: F.lit(sum(bit[n] for n in names)).cast("long")
    failed: dict[str, str] = {}

    def attempt(names, make):
        try:
            return make()
        except Exception as e:
            if not isolate:
                raise
            failed.update({n: suppress.message(e) for n in names})

    parts = [F.when((F.col("confidence") >= v.confidence) & (suppress.interior() if v.family == "iou_edgecrop" else F.lit(True)), bits([n])).otherwise(F.lit(0).cast("long")) for n, v in variants.items()]
    rows = cut(dets.withColumn("took", reduce(Column.bitwiseOR, parts)), "fixpoint-took")
    using: dict[tuple, list[str]] = {}
    for name, v in variants.items():
        if v.family != "none":
            using.setdefault(_graph(v), []).append(name)
    ends = rows.select("det_id", "took")
    dead, tables = [], []
    for key, names in using.items():
        passed = rows.where(F.col("confidence") >= min(variants[n].confidence for n in names))
        edges = attempt(names, lambda: _graph_edges(passed, key).select("killer", "victim"))
        if edges is None:
            continue
        for end in ("killer", "victim"):
            edges = edges.join(ends.withColumnsRenamed({"det_id": end, "took": f"{end}_took"}), end)
        edges = edges.select("killer", "victim", F.col("killer_took").bitwiseAND(F.col("victim_took")).bitwiseAND(bits(names)).alias("bits"))
        tables.append((names, cut(edges.where("bits != 0"), "fixpoint-graph")))
    scopes: dict[str, list[str]] = {}
    for name, v in variants.items():
        if v.family not in ("none", "nn_cluster") and name not in failed:
            scopes.setdefault(v.scope, []).append(name)
    every = [t for _, t in tables]
    for scope, names in scopes.items():
        mine = reduce(DataFrame.unionByName, every).withColumn("bits", F.col("bits").bitwiseAND(bits(names))).where("bits != 0")
        took = rows.withColumn("took", F.col("took").bitwiseAND(bits(names)))
        dead.append(attempt(names, lambda: dead_bits(took, mine, scope)))
    for names, table in tables:
        for name in names:
            if variants[name].family == "nn_cluster":
                has = lambda c: F.col(c).bitwiseAND(bits([name])) != 0
                gone = attempt([name], lambda: cluster_dead(rows.where(has("took")), table.where(has("bits")), variants[name].scope))
                dead.append(None if gone is None else gone.select("det_id", bits([name]).alias("dead")))
    discard(*every)
    none = rows.limit(0).select("det_id", F.lit(0).cast("long").alias("dead"))
    removed = reduce(DataFrame.unionByName, [d for d in dead if d is not None], none).groupBy("det_id").agg(F.bit_or("dead").alias("dead"))
    columns = ["slide_id", "overlap_pct", "det_id", "label", "tile_x", "tile_y"]
    keep = F.col("took").bitwiseAND(F.bitwise_not(F.coalesce("dead", F.lit(0).cast("long")))).bitwiseAND(bits([n for n in variants if n not in failed]))
    out = rows.select(*columns, "took").join(removed, "det_id", "left").select(*columns, keep.alias("mask"))
    if isolate:
        errors = [F.struct(F.lit(n).alias("nms_method"), F.lit(m).alias("error_msg")) for n, m in failed.items()]
        out = out.withColumn("errors", F.array(*errors) if errors else F.lit(None).cast(suppress.ERRORS.partition(" ")[2]))
    return out


def by_waves(dets: DataFrame, scope: str, variants: dict[str, suppress.Variant]) -> DataFrame:
    """(det_id, alive): the detections that survive variants of one scope, a bit each, with no table of conflicts.

    Blocks that can share a detection differ in bx + 2 by. So a pass over each value of that sum solves all its blocks,
    each a group (of one label, if no rule looks across labels) that is taken in chunks by priority and takes memory by its area. A detection
    enters with its first block and goes on with what that leaves, which lies apart and is few at any place.
    """
    if any(v.scope != scope or v.family == "none" for v in variants.values()):
        raise ValueError("variants of one scope that suppress something")
    grid = scope not in ("global", "grid_n1")
    n = int(scope[-1]) - 1 if grid else 1
    boxes = any(v.family.startswith("iou") for v in variants.values())
    across = any(v.family in ("iou", "iou_edgecrop") for v in variants.values())
    slide, zero = ["slide_id", "overlap_pct"], F.lit(0).cast("long")
    parts = [F.when((F.col("confidence") >= v.confidence) & (suppress.interior() if v.family == "iou_edgecrop" else F.lit(True)), F.lit(1 << k).cast("long")).otherwise(zero) for k, v in enumerate(variants.values())]
    rows = dets.withColumn("alive", reduce(Column.bitwiseOR, parts)).where("alive != 0")
    radii = {}
    for v in variants.values():
        if v.family == "nn_center" and (v.center_k, v.confidence) not in radii:
            radii[v.center_k, v.confidence] = name = f"radius_{len(radii)}"
            of = suppress.center_radii(dets.where(F.col("confidence") >= v.confidence), v.center_k)  # a row a slide, overlap and label
            rows = rows.join(F.broadcast(of.withColumnRenamed("radius", name)), [*slide, "label"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    used = [*slide, "label", "det_id", "confidence", *(["x1", "y1", "x2", "y2"] if boxes else []), "cx", "cy"]
    rows = rows.select(*used, *(F.col(c).cast("long").alias(c) for c in ("tile_x", "tile_y")), *radii.values(), "alive")
    schema, given = rows.schema, ("slide_id", "overlap_pct", "label", "det_id", "tile_x", "tile_y", "alive")
    carry = tuple(c for c in schema.names if c not in given)
    inside = [replace(v, scope="global") for v in variants.values()]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's rows, which come in order of priority and leave as they are settled."""
        stream = streams.Stream(inside, radii, carry=carry)

        def told(found: Iterator[dict]) -> Iterator[pa.RecordBatch]:
            for c in found:
                c["alive"] = c.pop("mask")
                yield pa.RecordBatch.from_arrays([c[name] for name in schema.names], schema.names)

        for table in streams.chunks(batches, stream.room):
            stream.take(table)
            yield from told(stream.ready())
        yield from told(stream.rows())

    keys = [*slide, *([] if across else ["label"])]
    usual = int(dets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # blocks are few rows but long work

    def solved(some: DataFrame, *place: Column) -> DataFrame:
        some = some.withColumns({f"_{k}": c for k, c in enumerate(place)})
        by = [*keys, *(f"_{k}" for k in range(len(place)))]
        return some.repartition(4 * usual, *by).sortWithinPartitions(*by, F.desc("confidence"), "det_id").groupBy(*by).applyInArrow(solve, schema)

    if not grid:
        place = [F.col("tile_x"), F.col("tile_y")] if scope == "grid_n1" else []
        return solved(rows, *place).select("det_id", "alive")
    blocks = []  # the up to four blocks that a tile lies in
    for i in (0, 1):
        for j in (0, 1):
            bx, by = F.expr(f"tile_x div {n} - {i}"), F.expr(f"tile_y div {n} - {j}")
            fits = (F.col("tile_x") >= 0) & (F.col("tile_y") >= 0) & (bx >= 0) & (by >= 0)
            fits = fits & (F.col("tile_x") % n == 0 if i else F.lit(True)) & (F.col("tile_y") % n == 0 if j else F.lit(True))
            blocks.append((F.when(fits, bx + 2 * by), bx, by))
    first = F.least(*(w for w, _, _ in blocks))
    most = dets.agg(F.max("tile_x"), F.max("tile_y")).first()
    most = [0 if m is None else max(int(m), 0) // n for m in most]
    carried = cut(rows.where(first.isNull()), "waves")  # in no block
    for t in range(most[0] + 2 * most[1] + 1):
        now = reduce(Column.__or__, [F.coalesce(w == t, F.lit(False)) for w, _, _ in blocks])
        x, y = (F.coalesce(*(F.when(w == t, b[k]) for w, *b in blocks)) for k in (0, 1))
        entering = rows.where(first == t).unionByName(carried.where(now))
        following = cut(solved(entering, x, y).unionByName(carried.where(~now)), "waves")
        discard(carried)
        carried = following
    return carried.select("det_id", "alive")


def by_variant(dets: DataFrame, v: suppress.Variant) -> DataFrame:
    """det_id of the survivors of one variant."""
    if v.family == "none":
        return dets.where(F.col("confidence") >= v.confidence).select("det_id")
    return by_waves(dets, v.scope, {"one": v}).select("det_id")
