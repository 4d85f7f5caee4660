"""Suppression in a crowded group, in one pass over its detections by falling priority.

Whether a detection survives a greedy rule depends on those before it only, in each block that holds it too. So the group is
taken in chunks: each is held against what was kept before in the same block, and solved inside. Rows that are kept
somewhere stay with all their columns; of the others only what the result names. The cluster rule is solved at the end by label, from the centres
that tie components (``Centres``); rows that cannot be the first of one are given out chunk by chunk.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import replace

import numpy as np
import pyarrow as pa

from tessella.operators import kernels

#: Rows up to which a group is not taken in chunks, and the least and the most that a chunk has. A chunk has its cost, so later ones are larger.
CROWDED, CHUNK, LARGEST = 196_608, 131_072, 262_144
#: Centres of a label and tile from which on those inside are dropped.
THIN = 4096
#: Rows of a batch of the result.
BATCH = 65_536
#: Families in which what passes a higher threshold fares as among all that pass a lower one.
NESTED = ("iou", "iou_classwise", "nn_dist")


def _small(a: np.ndarray) -> np.ndarray:
    fits = not len(a) or (a.min() >= -(2**31) and a.max() < 2**31)
    return a.astype(np.int32) if fits else a


def chunks(batches: Iterator[pa.RecordBatch], room: Callable[[], int]) -> Iterator[pa.Table]:
    """Tables of just over as many rows as ``room`` tells by then, the last of what is left."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n > room():
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


class Centres:
    """Centres of one radius and threshold, as far as components need them.

    Those of one label, tile and cell of radius / sqrt(2) belong together in every block, so none but the first of them can survive. To any centre outside
    the cell the nearest of them is the outermost of its row or column, so the others can go. Tiles before 0 are in no block and stay whole.
    """

    def __init__(self, distance: float):
        self.side = float(distance) / np.sqrt(2) * (1 - 1e-9)
        self.parts: dict[tuple, list] = {}  # by label and tile: arrays of x, y and number of the row, how many, and how many the last thinning left
        self.cells: dict[tuple, np.ndarray] = {}

    def copy(self) -> Centres:
        other = copy(self)
        other.parts, other.cells = {k: [list(p[0]), *p[1:]] for k, p in self.parts.items()}, dict(self.cells)
        return other

    def add(self, label: np.ndarray, tx: np.ndarray, ty: np.ndarray, x: np.ndarray, y: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Takes rows in order of priority; tells which may survive."""
        first = np.zeros(len(x), bool)
        if not len(x):
            return first
        order = np.lexsort((ty, tx, label))
        keys = [a[order] for a in (label, tx, ty)]
        starts = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
            key, at = tuple(int(k[a]) for k in keys), order[a:b]
            part = self.parts.setdefault(key, [[], 0, 0])
            part[0].append((x[at], y[at], row[at]))
            part[1] += len(at)
            if self.side <= 0 or min(key[1:]) < 0:
                first[at] = True
                continue
            cells, places = np.unique(self._cells(x[at], y[at]), return_index=True)
            known = self.cells.get(key, cells[:0])
            first[at[places[~np.isin(cells, known)]]] = True
            self.cells[key] = np.union1d(known, cells)
            if part[1] >= max(THIN, 2 * part[2]):
                self._thin(part)
        return first

    def _cells(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.floor(x / self.side) + 1j * np.floor(y / self.side)

    def _thin(self, part: list) -> None:
        x, y, row = (np.concatenate(a) for a in zip(*part[0], strict=True))
        _, first, cell = np.unique(self._cells(x, y), return_index=True, return_inverse=True)
        stays = np.zeros(len(x), bool)
        stays[first] = True
        for along, across in ((x, y), (y, x)):
            order = np.lexsort((along, across, cell))
            new = np.flatnonzero((np.diff(across[order]) != 0) | (np.diff(cell[order]) != 0))
            stays[order[np.r_[0, new + 1]]] = True
            stays[order[np.r_[new, len(order) - 1]]] = True
        part[:] = [[(x[stays], y[stays], row[stays])], int(stays.sum()), int(stays.sum())]

    def pop(self, label: int) -> tuple[np.ndarray, ...]:
        """x, y, tile numbers and rows of a label's centres, by priority; they are held no longer."""
        found = []
        for key in [k for k in self.parts if k[0] == label]:
            part = self.parts.pop(key)
            if self.side > 0 and min(key[1:]) >= 0:
                self._thin(part)
            found += [(x, y, np.full(len(x), key[1]), np.full(len(x), key[2]), row) for x, y, row in part[0]]
        columns = [np.concatenate(a) for a in zip(*found, strict=True)] if found else [np.zeros(0)] * 2 + [np.zeros(0, np.int64)] * 3
        order = np.argsort(columns[4])
        return tuple(a[order] for a in columns)


class Stream:
    """Takes the chunks of one slide (or tile) and overlap in order of priority, and then yields its rows.

    ``variants`` are numbered by their bits. ``radii`` names columns of radii by k and confidence. The column ``least_tile`` has
    the least tile number of the slide in x and y, ``tiles`` the largest plus one.
    """

    def __init__(self, variants: list, radii: dict[tuple, str], message=None, carry: tuple = ()):
        """Without ``message`` errors are raised; with it, it words those of a variant, whose bits are then 0.

        ``carry`` names columns of numbers that rows keep. With it the column ``alive`` has the variants that a row takes part in, as bits, and
        only rows that survive one are given out.
        """
        self.variants, self.radii, self.message, self.carry = variants, radii, message, carry
        self.errors: dict[int, str] = {}
        self.names: list = []  # labels by number
        self.radius: dict[tuple, np.ndarray] = {k: np.zeros(0) for k in radii}
        self.columns: dict[str, list] = defaultdict(list)  # of rows not given out
        self.numbers: list[np.ndarray] = []  # their places in the order of priority
        self.centres = {(v.distance, v.confidence): Centres(v.distance) for v in variants if v.family == "nn_cluster"}
        self.kept = {"x": np.zeros(0), "y": np.zeros(0), "label": np.zeros(0, np.int64), "boxes": np.zeros((0, 4), np.int64)}
        self.taken = 0
        self.blocks: dict[tuple, tuple] = {}  # by variant and wave: places of the kept, and the part of each
        self.plan: dict = {}

    def _open(self, table: pa.Table) -> None:
        self.slide, self.overlap = table["slide_id"][0], table["overlap_pct"][0]
        self.slide_type, self.overlap_type = table["slide_id"].type, table["overlap_pct"].type
        self.tiles, self.least = (table[c][0].as_py() for c in ("tiles", "least_tile")) if not self.carry else (1, 0)
        self.wide = self.tiles - self.least
        for k, v in enumerate(self.variants):
            if v.scope in [f"grid_n{n}" for n in range(max(self.tiles, 2), 10)] and self.least >= 0:
                v = replace(v, scope="global")  # the first block has all tiles
            self.plan[k] = v

    def _labels(self, column) -> np.ndarray:
        coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
        seen = coded.dictionary.to_pylist()
        self.names += [s for s in seen if s not in self.names]
        return np.array([self.names.index(s) for s in seen], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]

    def room(self) -> int:
        """Rows of the next chunk."""
        return min(max(CHUNK, self.taken), LARGEST)

    def copy(self) -> Stream:
        """One that goes on by itself from here."""
        other = copy(self)
        other.columns, other.numbers = defaultdict(list, {c: list(a) for c, a in self.columns.items()}), list(self.numbers)
        other.blocks, other.errors, other.centres = dict(self.blocks), dict(self.errors), {k: c.copy() for k, c in self.centres.items()}
        return other

    def take(self, table: pa.Table) -> None:
        self.read(table)
        self.solve()

    def read(self, table: pa.Table) -> None:
        """The chunk's columns as arrays, for ``solve``."""
        if not self.plan:
            self._open(table)
        self.taken += table.num_rows
        columns = table.column_names
        get = lambda c, kind=np.int64: table[c].to_numpy().astype(kind, copy=False) if c in columns else np.zeros(table.num_rows, kind)
        label, self.confidence = self._labels(table["label"]), get("confidence", float)
        boxes = np.stack([get(c) for c in ("x1", "y1", "x2", "y2")], axis=1)
        self.at = np.stack([get(c) for c in ("x_correct", "y_correct")], axis=1)
        self.tx, self.ty, self.ids = get("tile_x"), get("tile_y"), get("det_id")
        self.bits = get("alive") if self.carry else None
        self.carried = {c: table[c].to_numpy() for c in self.carry}
        self.chunk = {"x": get("cx", float), "y": get("cy", float), "label": label, "boxes": boxes}
        for key, name in self.radii.items():
            known = np.zeros(len(self.names))
            known[: len(self.radius[key])] = self.radius[key]
            known[label] = get(name, float)
            self.radius[key] = known

    def solve(self) -> None:
        """Takes the chunk that was read."""
        chunk, n, self.base = self.chunk, len(self.confidence), len(self.kept["x"])
        self.all = {c: np.concatenate([self.kept[c], chunk[c]]) for c in chunk}
        self.nears, self.fates, self.found = {}, {}, []
        mask = np.zeros(n, np.int64)
        for k, v in self.plan.items():
            if k not in self.errors:
                try:
                    fate = self._fate(v) if self.bits is None else self._survivors(v, (self.bits >> k & 1) == 1)
                    mask |= fate.astype(np.int64) << k
                except Exception as e:
                    if not self.message:
                        raise
                    self.errors[k] = self.message(e)
        self._keep(chunk, n)
        small = {**self.carried, "det_id": self.ids, "label": chunk["label"].astype(np.int16 if len(self.names) < 2**15 else np.int64), "tile_x": _small(self.tx), "tile_y": _small(self.ty), "mask": mask}
        if any(v.family == "nn_cluster" for v in self.variants):
            small |= {"x": chunk["x"], "y": chunk["y"]}
        for c, values in small.items():
            self.columns[c].append(np.array(values))
        self.stays = self._feed()
        del self.chunk, self.confidence, self.at, self.tx, self.ty, self.ids, self.bits, self.carried

    def _near(self, v):
        if v.family.startswith("iou"):
            key = (v.family == "iou_classwise", v.iou)
        else:
            key = ("center", v.center_k, v.confidence) if v.family == "nn_center" else ("distance", v.distance)
        if key not in self.nears:
            a = self.all
            if v.family.startswith("iou"):
                self.nears[key] = kernels.Boxes(a["boxes"], v.iou, a["label"] if key[0] else None)
            else:
                radius = self.radius[v.center_k, v.confidence][a["label"]] if v.family == "nn_center" else np.full(len(a["x"]), float(v.distance))
                self.nears[key] = kernels.Disks(a["x"], a["y"], a["label"], radius)
        return self.nears[key]

    def _waves(self, scope: str, alive: np.ndarray):
        """(number of the wave, nodes of the chunk, their blocks), and how many blocks there may be."""
        if scope == "global":
            return 1, [(0, np.flatnonzero(alive), np.zeros(len(alive), np.int64))]
        if scope == "grid_n1":
            return self.wide * self.wide, [(0, np.flatnonzero(alive), (self.ty - self.least) * self.wide + self.tx - self.least)]
        n = int(scope[-1]) - 1
        across = self.tiles // n + 1
        return across * across, ((w, *x) for w, x in enumerate(kernels._waves(n, self.tx, self.ty, alive, across)))

    def _fate(self, v) -> np.ndarray:
        """Which rows of the chunk survive a variant; under the cluster rule, which take part."""
        if v not in self.fates:
            self.fates[v] = self._survivors(v)
        return self.fates[v]

    def _survivors(self, v, among: np.ndarray | None = None) -> np.ndarray:
        alive = self.confidence >= v.confidence if among is None else among
        if v.family in ("none", "nn_cluster"):
            return alive
        if v.family in NESTED and among is None:
            low = min((w for w in self.plan.values() if replace(w, confidence=v.confidence) == v), key=lambda w: w.confidence)
            if low != v:
                return self._fate(low) & alive
        if v.family == "iou_edgecrop" and among is None:
            boxes, far = self.all["boxes"][self.base :], v.tile - v.edge
            alive &= (boxes[:, :2] - self.at > v.edge).all(1) & (boxes[:, 2:] - self.at < far).all(1)
        near, base = self._near(v), self.base
        places, waves = self._waves(v.scope, alive)
        part = np.zeros(base + len(alive), np.int64)
        for wave, nodes, place in waves:
            nodes = nodes[alive[nodes]]
            nodes = nodes[near.able[base + nodes]]
            if not len(nodes):
                continue
            kept, theirs = self.blocks.get((v, wave), (np.zeros(0, np.int64),) * 2)
            part[kept] = theirs
            part[base + nodes] = near.label[base + nodes] * places + place[nodes]
            alive[nodes] = False
            left = base + nodes[~kernels.struck(near, part, kept, base + nodes)] if len(kept) else base + nodes
            left = kernels.keep(near, part, left)
            alive[left - base] = True
            self.found.append(((v, wave), left - base, part[left]))
        return alive

    def _keep(self, chunk: dict, n: int) -> None:
        new = np.zeros(n, bool)
        for _, left, _ in self.found:
            new[left] = True
        place = self.base + np.cumsum(new) - 1
        self.kept = {c: np.concatenate([self.kept[c], chunk[c][new]]) for c in chunk}
        for key, left, part in self.found:
            old = self.blocks.get(key, (np.zeros(0, np.int64),) * 2)
            self.blocks[key] = np.concatenate([old[0], place[left]]), np.concatenate([old[1], part])
        del self.nears, self.fates, self.found, self.all

    def _feed(self) -> np.ndarray:
        """Feeds the chunk to the centres; tells which of its rows the cluster rule may still keep. Until the end their bits are 0."""
        last = {c: parts[-1] for c, parts in self.columns.items()}
        n = len(last["mask"])
        open_, numbers = np.zeros(n, bool), np.arange(self.taken - n, self.taken)
        for (distance, confidence), centres in self.centres.items():
            bits = [k for k, v in self.plan.items() if v.family == "nn_cluster" and (v.distance, v.confidence) == (distance, confidence)]
            mine = np.flatnonzero(last["mask"] >> bits[0] & 1)
            open_[mine[centres.add(*(last[c][mine] for c in ("label", "tile_x", "tile_y", "x", "y")), numbers[mine])]] = True
            for k in bits:
                last["mask"] &= ~(1 << k)
        self.numbers.append(numbers)
        return open_

    def ready(self) -> Iterator[dict]:
        """After each chunk: its rows that no later one can change, as columns, batch by batch."""
        stays, last = self.stays, {c: parts.pop() for c, parts in self.columns.items()}
        for c, values in last.items():
            self.columns[c].append(values[stays])
        self.numbers[-1] = self.numbers[-1][stays]
        yield from self._batches({c: values[~stays] for c, values in last.items()})

    def _clusters(self, c: dict, numbers: np.ndarray) -> None:
        for key, centres in self.centres.items():
            plan = [(k, v) for k, v in self.plan.items() if v.family == "nn_cluster" and (v.distance, v.confidence) == key]
            for label in range(len(self.names)):
                x, y, tx, ty, row = centres.pop(label)
                near, done = kernels.Disks(x, y, np.zeros(len(x), np.int64), np.full(len(x), float(key[0]))), {}
                for k, v in plan if len(x) else []:
                    if k in self.errors:
                        continue
                    try:
                        if v not in done:
                            done[v] = row[kernels.crowded_by_scope(v.scope, kernels.firsts, near, tx, ty, np.ones(len(x), bool))]
                        c["mask"][np.searchsorted(numbers, done[v])] |= 1 << k
                    except Exception as e:
                        if not self.message:
                            raise
                        self.errors[k] = self.message(e)

    def settle(self) -> dict:
        """The group's rows that were not given out before, as columns."""
        self.kept = self.blocks = None
        c = {name: np.concatenate(self.columns.pop(name)) for name in list(self.columns)}
        self._clusters(c, np.concatenate(self.numbers))
        for k in self.errors:
            c["mask"] &= ~(1 << k)
        return c

    def rows(self) -> Iterator[dict]:
        """What ``settle`` has, batch by batch."""
        yield from self._batches(self.settle())

    def _batches(self, c: dict) -> Iterator[dict]:
        names = pa.array(self.names, pa.string())
        if self.carry:
            some = c["mask"] != 0
            c = {name: values[some] for name, values in c.items()}
        for at in range(0, len(c["mask"]), BATCH):
            part = {name: c[name][at : at + BATCH] for name in ("det_id", "label", "tile_x", "tile_y", "mask", *self.carry)}
            n = len(part["mask"])
            yield {
                "slide_id": pa.repeat(self.slide, n).cast(self.slide_type), "overlap_pct": pa.repeat(self.overlap, n).cast(self.overlap_type), "det_id": pa.array(part["det_id"]),
                "label": names.take(pa.array(part["label"].astype(np.int64))), **{t: pa.array(part[t].astype(np.int64)) for t in ("tile_x", "tile_y", "mask")},
                **{name: pa.array(part[name]) for name in self.carry},
            }
