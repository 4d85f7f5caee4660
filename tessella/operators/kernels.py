"""Suppression inside one group of detections, on arrays.

All rules are defined on a conflict graph and one total order: confidence descending, then det_id. A greedy rule keeps
a detection unless a kept one before it conflicts with it. The order is acyclic, so the outcome is unique and can be
found in rounds over all undecided detections at once. The cluster rule keeps the first of each connected component.

Conflicts are found once a group, by binning to grids, and reused by every variant and every sliding block. In a crowded
group they grow with the square of the detections, so they are not listed there: what is kept lies apart and is few at any
place, and each detection is held against the kept before it only (``Disks``, ``Boxes``, ``keep``, ``firsts``).
"""

from __future__ import annotations

import numpy as np


#: Candidate pairs of a group up to which its conflicts are listed.
LISTED = 1_000_000
#: Candidate pairs looked at in one go, and those up to which a part of a crowded group is solved by its list.
STEP, BASE = 250_000, 1_000_000
#: Detections of which a part's candidate pairs are counted at all.
MOST = 65_536


def steps(low: np.ndarray, high: np.ndarray):
    """(places, members) of runs low..high, one for each place, in steps of about STEP members."""
    size = np.maximum(high - low, 0)
    ends = np.cumsum(size)
    at, total = 0, int(ends[-1]) if len(ends) else 0
    while at < len(size) and total > (ends[at - 1] if at else 0):
        done = int(ends[at - 1]) if at else 0
        to = max(int(np.searchsorted(ends, done + STEP, "right")), at + 1)
        n = size[at:to]
        i = np.repeat(np.arange(at, to), n)
        yield i, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:to], n)
        at = to


def _near_bins(x: np.ndarray, y: np.ndarray, reach: float):
    """Number of each point's cell, and by how much those of cells side by side differ."""
    cell = max(float(reach), 1.0)
    bx, by = np.floor((x - x.min()) / cell).astype(np.int64), np.floor((y - y.min()) / cell).astype(np.int64)
    tall = int(by.max()) + 3
    return (bx + 1) * tall + by + 1, tall


def _near_runs(x: np.ndarray, y: np.ndarray, reach: float):
    """Order of the points by cell, and for each kind of neighbouring cell the runs (low, high) that each point meets there."""
    n, (bins, tall) = len(x), _near_bins(x, y, reach)
    order = np.argsort(bins, kind="stable")
    ranked = bins[order]
    runs = []
    for step in (0, 1, tall - 1, tall, tall + 1):  # each pair of neighbouring bins once
        a, b = np.searchsorted(ranked, ranked + step, "left"), np.searchsorted(ranked, ranked + step, "right")
        runs.append((np.maximum(a, np.arange(n) + 1) if step == 0 else a, b))
    return order, runs


def near_pairs(x: np.ndarray, y: np.ndarray, reach: float, test=None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j (places) with both coordinates at most ``reach`` apart, and that pass the test if there is one."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(x) > 1:
        order, runs = _near_runs(x, y, reach)
        for a, b in runs:
            for i, j in steps(a, b):
                i, j = order[i], order[j]
                good = (np.abs(x[i] - x[j]) <= reach) & (np.abs(y[i] - y[j]) <= reach)
                i, j = np.minimum(i, j)[good], np.maximum(i, j)[good]
                if test is not None:
                    good = test(i, j)
                    i, j = i[good], j[good]
                left.append(i)
                right.append(j)
    return np.concatenate(left), np.concatenate(right)


def near_count(x: np.ndarray, y: np.ndarray, reach: float) -> int:
    """How many pairs ``near_pairs`` looks at."""
    if len(x) < 2:
        return 0
    bins, tall = _near_bins(x, y, reach)
    cells, size = np.unique(bins, return_counts=True)
    found = int((size * (size - 1) // 2).sum())
    for step in (1, tall - 1, tall, tall + 1):
        at = np.minimum(np.searchsorted(cells, cells + step), len(cells) - 1)
        found += int((size * size[at])[cells[at] == cells + step].sum())
    return found


def _cross_runs(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, cell: float):
    left, low = min(ax.min(), bx.min()), min(ay.min(), by.min())
    at = [np.floor((v - o) / cell).astype(np.int64) + 1 for v, o in ((ax, left), (ay, low), (bx, left), (by, low))]
    tall = int(max(at[1].max(), at[3].max())) + 2
    bins = at[2] * tall + at[3]
    order = np.argsort(bins, kind="stable")
    ranked, runs = bins[order], []
    for step in (-tall, 0, tall):  # three cells below one another are one run of bins
        first = at[0] * tall + at[1] + step
        runs.append((np.searchsorted(ranked, first - 1, "left"), np.searchsorted(ranked, first + 1, "right")))
    return order, runs


def cross_pairs(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, cell: float, test=None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i in a, j in b) whose points lie in the same or neighbouring cells of one grid, and that pass the test if there is one."""
    order, runs = _cross_runs(ax, ay, bx, by, cell)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in runs:
        for i, j in steps(a, b):
            j = order[j]
            good = slice(None) if test is None else test(i, j)
            left.append(i[good])
            right.append(j[good])
    return np.concatenate(left), np.concatenate(right)


def cross_count(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, cell: float) -> int:
    """How many pairs ``cross_pairs`` looks at."""
    return sum(int((b - a).sum()) for a, b in _cross_runs(ax, ay, bx, by, cell)[1])


def iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of boxes (x1, y1, x2, y2), row by row; 0 where the union is empty."""
    w = np.maximum(np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0]), 0)
    h = np.maximum(np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1]), 0)
    area = [np.maximum(t[:, 2] - t[:, 0], 0) * np.maximum(t[:, 3] - t[:, 1], 0) for t in (a, b)]
    both = w * h
    union = area[0] + area[1] - both
    return np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)


def levels_apart(threshold: float) -> int:
    """How many doublings of the larger side may lie between two boxes that overlap by the threshold.

    The overlap is at most the narrower width over the wider one, and the same for heights, so sides differ by 1 / threshold at most.
    """
    if threshold <= 0:
        raise ValueError("an overlap threshold is above 0")
    return int(np.ceil(np.log2(1 / threshold))) if threshold < 1 else 0


def iou_conflicts(boxes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j whose boxes overlap by the threshold or more; places are by priority.

    Boxes are dealt to levels by their larger side, below a power of two that is the level's cell. Each box meets those of its
    own level and, on their grid, of the few coarser ones that the threshold allows, so a box of any size costs the others nothing.
    """
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for mine, theirs, x, y, u, v, cell in _levels(boxes, threshold):
        test = lambda i, j, mine=mine, theirs=theirs: iou(boxes[mine[i]], boxes[theirs[j]]) >= threshold
        i, j = near_pairs(x, y, cell, test) if theirs is mine else cross_pairs(x, y, u, v, cell, test)
        left.append(np.minimum(mine[i], theirs[j]))
        right.append(np.maximum(mine[i], theirs[j]))
    return np.concatenate(left), np.concatenate(right)


def iou_count(boxes: np.ndarray, threshold: float) -> int:
    """How many pairs ``iou_conflicts`` looks at."""
    return sum(near_count(x, y, cell) if theirs is mine else cross_count(x, y, u, v, cell) for mine, theirs, x, y, u, v, cell in _levels(boxes, threshold))


def _levels(boxes: np.ndarray, threshold: float):
    """Places of one level and of one that it meets, their corners, and the cell."""
    side = np.maximum(boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1])
    solid = np.flatnonzero((boxes[:, 2] > boxes[:, 0]) & (boxes[:, 3] > boxes[:, 1]))  # others overlap nothing
    level = np.frexp(side[solid].astype(float))[1]
    members = {int(k): solid[level == k] for k in np.unique(level)}
    x, y = boxes[:, 0].astype(float), boxes[:, 1].astype(float)
    for k, mine in members.items():
        for wider in range(k, k + levels_apart(threshold) + 1):
            if wider in members:
                theirs = members[wider]
                yield mine, theirs, x[mine], y[mine], x[theirs], y[theirs], 2.0**wider


def distance_conflicts(x: np.ndarray, y: np.ndarray, label: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of one label whose centres are within the label's radius; no pair where it is 0."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in np.unique(label):  # each label on a grid of its own radius
        mine = np.flatnonzero(label == k)
        r = float(radius[mine[0]])
        if r > 0:
            i, j = near_pairs(x[mine], y[mine], r, lambda i, j, u=x[mine], v=y[mine], r=r: (u[i] - u[j]) ** 2 + (v[i] - v[j]) ** 2 <= r * r)
            left.append(mine[i])
            right.append(mine[j])
    return np.concatenate(left), np.concatenate(right)


def greedy(alive: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Greedy suppression among the alive along conflicts i before j; clears what is suppressed, in place."""
    live = alive[i] & alive[j]
    i, j = i[live], j[live]
    while len(i):
        waits = np.zeros(len(alive), bool)
        waits[j] = True  # has an undecided or kept one before it
        kept = ~waits[i]
        alive[j[kept]] = False
        left = alive[i] & alive[j] & ~kept
        i, j = i[left], j[left]


def components(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Least member of each place's connected component; ``label`` are those of edges that went before."""
    label = np.arange(n) if label is None else label.copy()
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def cluster(alive: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Keep the first of each component of the alive, in place."""
    live = alive[i] & alive[j]
    if live.any():
        alive &= components(len(alive), i[live], j[live]) == np.arange(len(alive))


def by_scope(scope: str, rule, i: np.ndarray, j: np.ndarray, tx: np.ndarray, ty: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Apply a rule inside one scope: the whole slide, each tile, or sliding n x n blocks that carry over.

    Blocks step by n - 1 tiles from tile 0, rows first; each sees only what the ones before it left alive.
    """
    alive = alive.copy()
    if scope == "global" or not len(tx):
        rule(alive, i, j)
        return alive
    if scope == "grid_n1":
        same = (tx[i] == tx[j]) & (ty[i] == ty[j])
        rule(alive, i[same], j[same])
        return alive
    n = int(scope[-1])
    used = np.flatnonzero(alive)
    if not len(used):
        return alive
    right, low = int(tx[used].max()), int(ty[used].max())
    near = (np.abs(tx[i] - tx[j]) < n) & (np.abs(ty[i] - ty[j]) < n) & alive[i] & alive[j]
    i, j = i[near], j[near]
    # conflicts by the tile of i, so that a block looks at its own ones only
    order = np.argsort(ty[i] * (right + 1) + tx[i], kind="stable")
    i, j = i[order], j[order]
    at = ty[i] * (right + 1) + tx[i]
    for by in range(0, low + 1, n - 1):
        for bx in range(0, right + 1, n - 1):
            spans = []
            for row in range(by, min(by + n, low + 1)):
                first = row * (right + 1) + bx
                spans.append(np.arange(*np.searchsorted(at, (first, row * (right + 1) + min(bx + n, right + 1)))))
            pick = np.concatenate(spans)
            a, b = i[pick], j[pick]
            inside = (tx[b] >= bx) & (tx[b] < bx + n) & (ty[b] >= by) & (ty[b] < by + n)
            a, b = a[inside], b[inside]
            if len(a):
                rule_on(rule, alive, a, b)
    return alive


def rule_on(rule, alive: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """A rule on the few places that a block's conflicts touch."""
    places, where = np.unique(np.concatenate([i, j]), return_inverse=True)
    some = alive[places]
    rule(some, where[: len(i)], where[len(i) :])
    alive[places] = some


# -- crowded groups ---------------------------------------------------------------------------------------------------


class Disks:
    """Conflicts of centres of one label within its radius."""

    def __init__(self, x: np.ndarray, y: np.ndarray, label: np.ndarray, radius: np.ndarray):
        self.x, self.y, self.label, self.radius = x, y, label, radius
        self.able = radius > 0
        self.kind = np.zeros(len(x), np.int64)

    def candidates(self, at: np.ndarray) -> int:
        x, y, label, radius = self.x[at], self.y[at], self.label[at], self.radius[at]
        parts = [np.flatnonzero((label == k) & (radius > 0)) for k in np.unique(label)]
        return sum(near_count(x[m], y[m], float(radius[m[0]])) for m in parts if len(m))

    def looks(self, kinds, others):
        return [(0, 0)]

    def cells(self, at: np.ndarray, kind: int, other: int):
        r = self.radius[at] * (1 + 1e-9)
        return np.floor(self.x[at] / r).astype(np.int64), np.floor(self.y[at] / r).astype(np.int64)

    def test(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.x[i] - self.x[j]) ** 2 + (self.y[i] - self.y[j]) ** 2 <= self.radius[i] * self.radius[i]

    def reach(self, at: np.ndarray, kind: int, other: int):
        return self.radius[at], self.radius[at]

    def within(self, at: np.ndarray):
        return distance_conflicts(self.x[at], self.y[at], self.label[at], self.radius[at])

    def spots(self, at: np.ndarray):
        """Cells of radius / sqrt(2): each holds one kept disk of a part at most, and conflicts reach two cells."""
        side = self.radius[at] / np.sqrt(2) * (1 - 1e-9)
        return [np.floor(v[at] / side).astype(np.int64) for v in (self.x, self.y)]

    def shifts(self):
        every = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3)]
        return sorted(every, key=lambda d: d[0] ** 2 + d[1] ** 2)


class Boxes:
    """Conflicts of boxes that overlap by the threshold; of one label only if labels are given.

    A kind is a range of widths and one of heights, a factor of about 1.4 each. How far two centres of two kinds may lie
    apart follows from the threshold, and is the cell in which they are looked for.
    """

    def __init__(self, boxes: np.ndarray, threshold: float, label: np.ndarray | None = None):
        self.boxes, self.threshold = boxes, threshold
        self.label = np.zeros(len(boxes), np.int64) if label is None else label
        self.able = (boxes[:, 2] > boxes[:, 0]) & (boxes[:, 3] > boxes[:, 1])
        self.x, self.y = (boxes[:, 0] + boxes[:, 2]) / 2.0, (boxes[:, 1] + boxes[:, 3]) / 2.0
        sides = [np.maximum(boxes[:, k + 2] - boxes[:, k], 1) for k in (0, 1)]
        self.kind = sum(np.floor(2 * np.log2(s)).astype(np.int64) * m for s, m in zip(sides, (1000, 1), strict=True))
        self.range = {}
        for k in np.unique(self.kind):
            mine = self.kind == k
            self.range[int(k)] = [(int(s[mine].min()), int(np.ceil(s[mine].max()))) for s in sides]

    def candidates(self, at: np.ndarray) -> int:
        return iou_count(self.boxes[at], self.threshold)

    def looks(self, kinds, others):
        """Pairs of kinds that can overlap by the threshold, the most similar first."""
        found = []
        for k in kinds:
            for o in others:
                if all(min(a[1], b[1]) >= self.threshold * max(a[0], b[0]) for a, b in zip(self.range[k], self.range[o], strict=True)):
                    found.append((abs(k // 1000 - o // 1000) + abs(k % 1000 - o % 1000), k, o))
        return [(k, o) for _, k, o in sorted(found)]

    def cells(self, at: np.ndarray, kind: int, other: int):
        out = []
        for v, a, b in zip((self.x, self.y), self.range[kind], self.range[other], strict=True):
            # the overlap of two sides is the threshold times the wider one at least
            apart = min((a[1] + b[1]) / 2 - self.threshold * max(a[0], b[0]), max(1 - self.threshold, 0) * max(a[1], b[1]))
            out.append(np.floor(v[at] / (max(apart, 0.5) * (1 + 1e-9))).astype(np.int64))
        return out

    def reach(self, at: np.ndarray, kind: int, other: int):
        """How far in x and in y the centres of boxes of the other kind may lie from each of these."""
        out = []
        for k, (low, high) in enumerate(self.range[other]):
            side, most = self.boxes[at, k + 2] - self.boxes[at, k], np.zeros(len(at))
            for theirs in (np.clip(side, low, high), high):  # it rises up to an equal side, and from there by 1/2 - threshold
                most = np.maximum(most, (side + theirs) / 2 - self.threshold * np.maximum(side, theirs))
            out.append(most)
        return out

    def test(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return iou(self.boxes[i], self.boxes[j]) >= self.threshold

    def spots(self, at: np.ndarray):
        """Cells of centres and sides. They may hold several kept boxes, and conflicts reach beyond the shifts: what stands there settles most boxes, not all."""
        wide, high = (np.floor(2 * np.log2(np.maximum(self.boxes[at, k + 2] - self.boxes[at, k], 1))).astype(np.int64) for k in (0, 1))
        return [np.floor(v[at] / 12).astype(np.int64) for v in (self.x, self.y)] + [wide, high]

    def shifts(self):
        every = [(*d, *k) for d in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (1, -1), (-1, 1), (-1, -1)) for k in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))]
        return sorted(every, key=lambda d: d[0] ** 2 + d[1] ** 2 + d[2] ** 2 + d[3] ** 2)

    def within(self, at: np.ndarray):
        i, j = iou_conflicts(self.boxes[at], self.threshold)
        same = self.label[at[i]] == self.label[at[j]]
        return i[same], j[same]


#: Places of the table of ``met``.
TABLE = 1 << 25


def met(near, part: np.ndarray, kept: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, bool]:
    """Which of the nodes conflict with the kept that stands for one of the cells around them, and whether these are all that conflict.

    A table has one of the kept for each part and cell. It tells all where no two kept share a cell and no conflict reaches beyond the shifts.
    """
    hit, shifts = np.zeros(len(nodes), bool), near.shifts()
    if not len(kept) or not len(nodes):
        return hit, True
    theirs, mine = near.spots(kept), near.spots(nodes)
    groups = np.unique(part[kept])
    here = np.minimum(np.searchsorted(groups, part[nodes]), len(groups) - 1)
    known = groups[here] == part[nodes]
    theirs, mine = [np.searchsorted(groups, part[kept]), *theirs], [here, *mine]
    reach = [0, *(max(abs(d[k]) for d in shifts) for k in range(len(shifts[0])))]
    low = [int(a.min()) - 2 * r for a, r in zip(theirs, reach, strict=True)]
    size = [int(a.max()) + 2 * r + 1 - b for a, r, b in zip(theirs, reach, low, strict=True)]
    if np.prod([float(s) for s in size]) > TABLE:
        return hit, False
    for a, r, b, s in zip(mine, reach, low, size, strict=True):
        known &= (a - b >= r) & (a - b < s - r)  # no shift leads from others to a cell with one that is kept
    weight = np.cumprod([1, *size[:0:-1]])[::-1]
    table = np.full(int(np.prod(size)), -1, np.int32)
    spot = sum((a - b) * w for a, b, w in zip(theirs, low, weight, strict=True))
    table[spot] = kept
    whole = isinstance(near, Disks) and len(np.unique(spot)) == len(kept)
    left = np.flatnonzero(known)
    at = sum((a[left] - b) * w for a, b, w in zip(mine, low, weight, strict=True))
    for d in shifts:
        other = table[at + sum(int(x) * int(w) for x, w in zip(d, weight[1:], strict=True))]
        some = np.flatnonzero(other >= 0)
        killed = some[near.test(nodes[left[some]], other[some])]
        if len(killed):
            hit[left[killed]] = True
            stay = np.ones(len(left), bool)
            stay[killed] = False
            left, at = left[stay], at[stay]
    return hit, whole


def struck(near, part: np.ndarray, kept: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Which of the nodes conflict with one of the kept in the same part. What the nearest cells settle is looked at no further."""
    hit, every = met(near, part, kept, nodes)
    if every:
        return hit
    kind = np.where(hit, np.iinfo(np.int64).min, near.kind[nodes])
    kinds = {int(k): np.flatnonzero(kind == k) for k in np.unique(kind[~hit])}
    others = {int(k): kept[near.kind[kept] == k] for k in np.unique(near.kind[kept])}
    looks = near.looks(kinds, others)
    for own, kind, other in [(True, k, o) for k, o in looks if k == o] + [(False, k, o) for k, o in looks]:
        mine = kinds[kind][~hit[kinds[kind]]]
        theirs = others[other]
        if not len(mine) or not len(theirs):
            continue
        at = nodes[mine]
        (ax, ay), (bx, by) = near.cells(at, kind, other), near.cells(theirs, kind, other)
        left, low = min(ax.min(), bx.min()) - 1, min(ay.min(), by.min()) - 1
        wide, tall = max(ax.max(), bx.max()) - left + 2, max(ay.max(), by.max()) - low + 2
        key = lambda p, x, y: (p * wide + (x - left)) * tall + (y - low)  # noqa: B023, E731
        bins = key(part[theirs], bx, by)
        order = np.argsort(bins, kind="stable")
        ranked, theirs = bins[order], theirs[order]
        bins = key(part[at], ax, ay)
        for step, reach in ((0, 0),) if own else ((0, 1), (-tall, 1), (tall, 1)):
            some = np.flatnonzero(~hit[mine])
            low_, high = np.searchsorted(ranked, bins[some] + step - reach, "left"), np.searchsorted(ranked, bins[some] + step + reach, "right")
            for i, j in steps(low_, high):
                hit[mine[some[i[near.test(at[some[i]], theirs[j])]]]] = True
    return hit


def meetings(near, part: np.ndarray, own: np.ndarray):
    """All conflicts (i, j) inside each part, but those of two places that are not ``own``, step by step.

    Places are ordered along strips. One meets those of its strip and of the two beside it whose centres lie within its reach.
    """
    kinds, visits = ({int(k): np.flatnonzero(some & (near.kind == k)) for k in np.unique(near.kind[some])} for some in (own, ~own))
    empty = np.zeros(0, np.int64)
    for kind, other in near.looks(kinds, kinds | visits):
        mine, them = kinds.get(kind, empty), visits.get(other, empty)
        if kind <= other:  # two own places once
            them = np.concatenate([them, kinds.get(other, empty)])
        if not len(mine) or not len(them):
            continue
        wide, high = near.reach(mine, kind, other)
        strip = max(float(wide.max()), 0.5) * (1 + 1e-9)
        rows = []
        for at in (mine, them):
            rows.append([part[at], np.floor(near.x[at] / strip), near.y[at]])
        least = np.full((2, int(max(rows[0][0].max(), rows[1][0].max())) + 1), np.inf)
        for where, x, y in rows:
            np.minimum.at(least[0], where, x)
            np.minimum.at(least[1], where, y)
        rows = [(where, x - least[0, where] + 1, y - least[1, where]) for where, x, y in rows]
        across, span = max(float(x.max()) for _, x, _ in rows) + 2, max(float(y.max()) for _, _, y in rows) + float(high.max()) + 1
        keys = [(where * across + x) * span + y for where, x, y in rows]
        orders = [np.argsort(k, kind="stable") for k in keys]
        (bins, ranked), (mine, them) = ([a[o] for a, o in zip(both, orders, strict=True)] for both in (keys, (mine, them)))
        wide, high = wide[orders[0]], high[orders[0]] * (1 + 1e-9) + max(float(k.max()) for k in keys) * 1e-14
        for step in (-span, 0.0, span):
            for at, j in steps(np.searchsorted(ranked, bins + step - high, "left"), np.searchsorted(ranked, bins + step + high, "right")):
                i, j = mine[at], them[j]
                some = np.abs(near.x[i] - near.x[j]) <= wide[at] * (1 + 1e-9)
                if kind == other:
                    some &= ~own[j] | (i < j)
                i, j = i[some], j[some]
                some = near.test(i, j)
                yield i[some], j[some]


def keep(near, part: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Greedy suppression among the nodes (in order of priority) inside each part: the first half, what it leaves of the second, and so on."""
    able = near.able[nodes]
    return np.concatenate([nodes[~able], _halves(near, part, nodes[able])])


def _halves(near, part: np.ndarray, some: np.ndarray) -> np.ndarray:
    # not a closure: one that calls itself is a cycle, and holds all these arrays until Python next looks for cycles
    if len(some) < 3 or len(some) <= MOST and near.candidates(some) <= BASE:
        i, j = near.within(some)
        same = part[some[i]] == part[some[j]]
        alive = np.ones(len(some), bool)
        greedy(alive, i[same], j[same])
        return some[alive]
    first, rest = _halves(near, part, some[: len(some) // 2]), some[len(some) // 2 :]
    return np.concatenate([first, _halves(near, part, rest[~struck(near, part, first, rest)])])


def firsts(near: Disks, part: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The first of each connected component of disks inside each part.

    All centres of a cell of radius / sqrt(2) belong together, so cells are what is joined: by the centres that lie
    farthest towards each other, and for cells that these leave apart by all their centres.
    """
    able = near.able[nodes]
    free, nodes = nodes[~able], nodes[able]
    if not len(nodes):
        return free
    side = near.radius[nodes] / np.sqrt(2) * (1 - 1e-9)
    bx, by = np.floor(near.x[nodes] / side).astype(np.int64), np.floor(near.y[nodes] / side).astype(np.int64)
    left, low = bx.min() - 2, by.min() - 3
    wide, tall = bx.max() - left + 3, by.max() - low + 4
    keys = (part[nodes] * wide + (bx - left)) * tall + (by - low)
    cells, inside = np.unique(keys, return_inverse=True)
    # each place once, in the order of cells
    order = np.lexsort((near.y[nodes], near.x[nodes], inside))
    x, y, cell = near.x[nodes][order], near.y[nodes][order], inside[order]
    new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (cell[1:] != cell[:-1])]
    spot, x, y, cell = nodes[order][new], x[new], y[new], cell[new]
    start = np.searchsorted(cell, np.arange(len(cells)))
    end = np.r_[start[1:], len(cell)]
    label = np.arange(len(cells))
    offsets = [(dx, dy) for dx in range(3) for dy in range(-2, 3) if (dx, dy) > (0, 0)]
    beside = {}
    for dx, dy in offsets:
        at = np.minimum(np.searchsorted(cells, cells + dx * tall + dy), len(cells) - 1)
        a = np.flatnonzero(cells[at] == cells + dx * tall + dy)
        beside[dx, dy] = a, at[a]
        if len(a):
            toward = dx * x + dy * y
            far = np.lexsort((toward, cell))  # of each cell the last is the farthest in this direction, the first the farthest back
            i, j = spot[far[end[a] - 1]], spot[far[start[at[a]]]]
            hit = near.test(i, j)
            label = components(len(cells), a[hit], at[a][hit], label)
    for a, b in beside.values():
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        for pair, i in steps(start[a], end[a]):
            for k, j in steps(start[b[pair]], end[b[pair]]):
                open_ = label[a[pair[k]]] != label[b[pair[k]]]
                k, j = k[open_], j[open_]
                hit = near.test(spot[i[k]], spot[j])
                label = components(len(cells), a[pair[k[hit]]], b[pair[k[hit]]], label)
    return np.concatenate([free, nodes[np.unique(label[inside], return_index=True)[1]]])


def crowded_by_scope(scope: str, rule, near, tx: np.ndarray, ty: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """As ``by_scope``, without a list of conflicts: blocks that share no tile are the parts of one pass.

    Blocks that share a tile differ in bx + 2 by, and come in the order of that sum.
    """
    labels = int(near.label.max()) + 1
    part = near.label.copy()
    if scope == "global":
        waves = [(np.flatnonzero(alive), None)]
    elif scope == "grid_n1":
        place = (ty - ty.min()) * (tx.max() - tx.min() + 1) + tx - tx.min()
        waves = [(np.flatnonzero(alive), place)]
    else:
        waves = _waves(int(scope[-1]) - 1, tx, ty, alive)
    alive = alive.copy()
    for nodes, place in waves:
        nodes = nodes[alive[nodes]]
        if len(nodes):
            part[nodes] = near.label[nodes] + (0 if place is None else place[nodes] * labels)
            alive[nodes] = False
            alive[rule(near, part, nodes)] = True
    return alive


def _waves(n: int, tx: np.ndarray, ty: np.ndarray, alive: np.ndarray, across: int | None = None):
    """(nodes, block of each) for each value of bx + 2 by; a block of n + 1 tiles starts at each multiple of n from 0.

    ``across`` numbers the blocks alike for parts of a slide: no fewer than lie side by side.
    """
    inside = alive & (tx >= 0) & (ty >= 0)
    nodes = np.flatnonzero(inside)
    if not len(nodes):
        return
    across = across or int(tx[nodes].max()) // n + 1
    at = {(i, j): (tx // n - i, ty // n - j) for i in (0, 1) for j in (0, 1)}
    fits = {k: inside & (x >= 0) & (y >= 0) & ((k[0] == 0) | (tx % n == 0)) & ((k[1] == 0) | (ty % n == 0)) for k, (x, y) in at.items()}
    for wave in range(across + 2 * (int(ty[nodes].max()) // n) + 1):
        place, mine = np.full(len(tx), -1, np.int64), np.zeros(len(tx), bool)
        for k, (x, y) in at.items():
            now = fits[k] & (x + 2 * y == wave)
            place[now] = (y * across + x)[now]
            mine |= now
        yield np.flatnonzero(mine), place
