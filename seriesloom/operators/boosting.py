"""Boosted regression trees; several models grow side by side over the same stored rows.

Features are cut into bins once, at quantiles of all training rows. A stored row is then a byte per feature, its labels and a
hash, in blocks that a task adds up whole. A pass over these rows serves one level of the current tree of every model: a task adds its rows into sums per node,
feature and bin, whatever its number of rows, and the driver adds the tasks' sums and picks the splits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.blocks import Blocks, block, each, few_parts, small_batches, sums

#: Points that stand for the sorted values of a feature in a task; up to this many distinct values are kept as they are.
POINTS = 512
#: Sums of one pass (nodes times features times bins, over all models); a level with more nodes takes several passes.
CELLS = 1 << 17
#: Values of a part column: a row that a model learns from, one that tells it when to stop, and one that it is judged by.
TRAIN, VALID, HELD = 1, 2, 3


@dataclass
class Job:
    """One model: its settings, the columns of its label and part, and its features in the order of its vector."""

    params: Mapping
    label: str
    part: str
    names: Sequence[str]
    early: bool = False


@dataclass
class Bins:
    """Cut points per feature: bin ``j`` ends with cut ``j``. A missing value counts as ``means``; ``gaps`` counts them."""

    names: list[str]
    cuts: list[np.ndarray]
    means: np.ndarray
    gaps: np.ndarray

    @property
    def flagged(self) -> list[str]:
        return [n for n, g in zip(self.names, self.gaps, strict=True) if g]

    @property
    def columns(self) -> list[str]:
        return [*self.names, *[f"{n}_missing" for n in self.flagged]]

    @property
    def kind(self) -> type:
        return np.uint8 if all(len(c) < 256 for c in self.cuts) else np.uint16

    def cuts_of(self, column: str) -> np.ndarray:
        return self.cuts[self.names.index(column)] if column in self.names else np.array([0.5])


@dataclass
class Tree:
    """Nodes by heap number (root 1, children 2i and 2i + 1); a leaf sends all rows left, down to its own value."""

    depth: int
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    #: Per split node: gain times rows.
    splits: dict[int, float] = field(default_factory=dict)

    @classmethod
    def stump(cls, depth: int) -> Tree:
        size = 1 << (depth + 1)
        return cls(depth, np.zeros(size, np.int64), np.full(size, 1 << 16, np.int64), np.zeros(size))

    def fill(self, node: int, value: float) -> None:
        """The value of a node until it is split, and of the leaves that its rows reach."""
        while node < len(self.value):
            self.value[node] = value
            node *= 2


@dataclass
class Boosted:
    """A fitted model over columns: trees, their shares, and the cut points of the columns."""

    columns: list[str]
    cuts: list[np.ndarray]
    trees: list[Tree]
    shares: list[float]

    def expression(self, values: Callable[[str], Column]) -> Column:
        """The prediction from the values of the columns."""

        def below(tree: Tree, node: int) -> Column:
            if node not in tree.splits:
                return F.lit(float(tree.value[node]))
            i = tree.feature[node]
            edge = float(self.cuts[i][tree.cut[node]])
            return F.when(values(self.columns[i]) <= edge, below(tree, 2 * node)).otherwise(below(tree, 2 * node + 1))

        parts = [below(t, 1) * F.lit(float(s)) for t, s in zip(self.trees, self.shares, strict=True)]
        return sum(parts[1:], parts[0])

    @property
    def used(self) -> list[str]:
        return [self.columns[i] for i in sorted({int(t.feature[n]) for t in self.trees for n in t.splits})]

    def gains(self) -> list[float]:
        """Share of every column in the total gain, as zeros without any split."""
        total = np.zeros(len(self.columns))
        for t in self.trees:
            for node, gain in t.splits.items():
                total[t.feature[node]] += gain
        return list(total / total.sum() if total.sum() > 0 else total)

    def counts(self) -> list[int]:
        """Splits by column."""
        return list(np.bincount([t.feature[n] for t in self.trees for n in t.splits], minlength=len(self.columns)))


# --- cut points -------------------------------------------------------------------------


def _points(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted values and their weights, at most ``POINTS``: values at evenly spaced ranks stand for more."""
    if not len(values):
        return values, weights
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    weights = np.add.reduceat(weights, start)
    values = values[start]
    if len(values) <= POINTS:
        return values, weights
    upto = np.cumsum(weights)
    at = np.searchsorted(upto, (np.arange(POINTS) + 0.5) * upto[-1] / POINTS)
    values, many = np.unique(values[at], return_counts=True)
    return values, many * (upto[-1] / POINTS)


def _merged(parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    values, weights = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(values, kind="stable")
    return _points(values[order], weights[order])


def _cuts(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Middles between neighbours: all of them if they are few, else those closest to evenly spaced ranks."""
    middles = (values[1:] + values[:-1]) / 2
    if len(middles) < bins:
        return middles
    upto = np.cumsum(weights)
    wanted = np.arange(1, bins) * upto[-1] / bins
    right = np.clip(np.searchsorted(upto, wanted), 1, len(middles) - 1)
    return np.unique(middles[np.where(wanted - upto[right - 1] < upto[right] - wanted, right - 1, right)])


def learn_bins(store: Blocks, names: Sequence[str], parts: Sequence[str]) -> Callable[[int], Bins]:
    """Bins for a number of bins, from one pass over all rows that any model learns from."""
    names, of_names, of_parts = list(names), store.at(names), store.at(parts)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in names]
        known, total, seen = np.zeros(len(names)), np.zeros(len(names)), 0
        for (rows,) in each(batches, np.float64):
            learns = np.flatnonzero(np.any(rows[of_parts] == TRAIN, axis=0))
            seen += len(learns)
            for i, c in enumerate(of_names):
                x = np.sort(rows[c][learns])
                x = x[: np.searchsorted(x, np.nan)]
                known[i] += len(x)
                total[i] += x.sum()
                held[i].append(_points(x, np.ones(len(x))))
            if len(held[0]) >= 32:
                held = [[_merged(h)] for h in held]
        for i, h in enumerate(held):
            points = _merged(h) if h else (np.zeros(0), np.zeros(0))
            fields = [[i], [seen], [known[i]], [total[i]], *[pa.array([p.tobytes()], pa.binary()) for p in points]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in fields], ["i", "seen", "known", "total", "v", "w"])

    shape = "i long, seen long, known double, total double, v binary, w binary"
    with small_batches(store.df.sparkSession):
        made = few_parts(store.df).mapInArrow(task, shape).collect()
    seen = sum(r.seen for r in made if r.i == 0)
    known, total = np.zeros(len(names)), np.zeros(len(names))
    held = [[(np.zeros(0), np.zeros(0))] for _ in names]
    for r in made:
        known[r.i] += r.known
        total[r.i] += r.total
        held[r.i].append((np.frombuffer(r.v), np.frombuffer(r.w)))
    points = [_merged(h) for h in held]
    means = np.where(known > 0, total / np.maximum(known, 1), 0.0)
    return lambda bins: Bins(names, [_cuts(v, w, bins) for v, w in points], means, seen - known)


def binned(store: Blocks, bins: Bins, others: Sequence[str]) -> DataFrame:
    """Blocks of two matrices: bins of all columns, and the other columns."""
    of_names, of_others = store.at(bins.names), store.at(others)
    flagged = [bins.names.index(n) for n in bins.flagged]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (rows,) in each(batches, np.float64):
            out = np.empty((len(bins.columns), rows.shape[1]), bins.kind)
            for i, c in enumerate(of_names):
                missing = np.isnan(rows[c])
                out[i] = np.searchsorted(bins.cuts[i], np.where(missing, bins.means[i], rows[c]))
                if i in flagged:
                    out[len(bins.names) + flagged.index(i)] = missing
            yield block(rows.shape[1], out, rows[of_others])

    return store.df.mapInArrow(task, "n int, x0 binary, x1 binary")


# --- growing ----------------------------------------------------------------------------


def uniform(row: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) from the hashes of rows: the same rows are drawn however the table is dealt."""
    with np.errstate(over="ignore"):
        x = row.view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def _nodes(bins: np.ndarray, tree: Tree, depth: int) -> np.ndarray:
    """The node of every row after ``depth`` steps."""
    n = bins.shape[1]
    node, at, flat = np.ones(n, np.int64), np.arange(n), bins.ravel()
    for _ in range(depth):
        node = 2 * node + (flat[tree.feature[node] * n + at] > tree.cut[node])
    return node


def _made(bins: np.ndarray, trees: Sequence[Tree], shares: Sequence[float]) -> np.ndarray:
    made = np.zeros(bins.shape[1])
    for tree, share in zip(trees, shares, strict=True):
        made += share * tree.value[_nodes(bins, tree, tree.depth)]
    return made


@dataclass
class _Ask:
    """What one model needs of a pass; its sums are (bins per node and feature) of weight times label, weight, and rows."""

    label: str
    part: str
    squared: bool
    share: float
    seed: int
    columns: np.ndarray
    width: int
    trees: list[Tree]
    shares: list[float]
    tree: Tree
    level: int
    nodes: list[int]
    error: bool

    @property
    def size(self) -> int:
        return 2 + 3 * len(self.nodes) * len(self.columns) * self.width

    def add(self, sums: np.ndarray, bins: np.ndarray, drawn: np.ndarray, weight: np.ndarray, y: np.ndarray, part: np.ndarray) -> None:
        made = _made(bins, self.trees, self.shares)
        if self.error:
            held = part == VALID
            off = y[held] - made[held]
            sums[0] += np.sum(weight[held] * (off * off if self.squared else np.abs(off)))
            sums[1] += np.sum(weight[held])
        if not self.nodes:
            return
        slots = np.full(2 << self.level, -1)
        slots[self.nodes] = np.arange(len(self.nodes))
        slot = slots[_nodes(bins, self.tree, self.level)]
        use = np.flatnonzero((part == TRAIN) & (slot >= 0) & (drawn < self.share))
        if not len(use):
            return
        rest = y[use]
        if self.trees:
            rest = 2.0 * (rest - made[use]) if self.squared else np.where(rest - made[use] < 0, -1.0, 1.0)
        w, base, cells = weight[use], slot[use] * self.width, len(self.nodes) * self.width
        plain = bool(np.all(w == 1.0))
        wy = rest if plain else w * rest
        out = sums[2:].reshape(3, len(self.columns), cells)
        for i, c in enumerate(self.columns):
            at = base + bins[c][use]
            rows = np.bincount(at, minlength=cells)
            out[0, i] += np.bincount(at, wy, cells)
            out[1, i] += rows if plain else np.bincount(at, w, cells)
            out[2, i] += rows


def _add_up(data: DataFrame, asks: Sequence[_Ask], others: Sequence[str], kind: type) -> list[np.ndarray]:
    """The sums of all asks over all rows: one pass."""
    asks, at = list(asks), {c: i for i, c in enumerate(others)}
    ends = np.cumsum([a.size for a in asks])

    def add(batches: Iterator[pa.RecordBatch], total: np.ndarray) -> None:
        for bins, rest in each(batches, kind, np.float64):
            drawn = {seed: uniform(rest[at["_row"]].view(np.int64), seed) for seed in {a.seed for a in asks}}
            for a, own in zip(asks, np.split(total, ends[:-1]), strict=True):
                a.add(own, bins, drawn[a.seed], rest[at["_weight"]], rest[at[a.label]], rest[at[a.part]])

    return np.split(sums(data, add, int(ends[-1])), ends[:-1])


def predictions(data: DataFrame, models: Mapping[int, tuple[Boosted, np.ndarray]], label: int, part: int, kind: type) -> DataFrame:
    """``_y`` and ``_p<i>`` of every model, over the rows that models are judged by."""
    own = {i: ([Tree(t.depth, columns[t.feature], t.cut, t.value) for t in m.trees], m.shares) for i, (m, columns) in models.items()}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, rest in each(batches, kind, np.float64):
            use = np.flatnonzero(rest[part] == HELD)
            held = np.ascontiguousarray(bins[:, use])
            made = [_made(held, trees, shares) for trees, shares in own.values()]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (rest[label][use], *made)], ["_y", *[f"_p{i}" for i in own]])

    return few_parts(data).mapInArrow(task, ", ".join(["_y double", *[f"_p{i} double" for i in own]]))


class _Growing:
    """The state of one model between passes."""

    def __init__(self, job: Job, bins: Bins):
        p = self.params = job.params
        self.job, self.width = job, max(2, *[len(c) + 1 for c in bins.cuts]) if bins.cuts else 2
        self.names = [*job.names, *[f"{n}_missing" for n in job.names if n in bins.flagged]]
        self.cuts = [bins.cuts_of(c) for c in self.names]
        self.columns = np.array([bins.columns.index(c) for c in self.names], np.int64)
        self.squared = p["objective"] == "regression"
        self.depth, self.rounds = p["max_depth"], p["max_iter"]
        self.trees: list[Tree] = []
        self.best, self.best_error, self.done = 0, np.inf, False
        self._next_tree()

    def _next_tree(self) -> None:
        self.tree, self.level, self.waiting, self.children = Tree.stump(self.depth), 0, [1], []

    @property
    def shares(self) -> list[float]:
        return [1.0 if i == 0 else self.params["learning_rate"] for i in range(len(self.trees))]

    def ask(self, cells: int) -> _Ask:
        most = max(1, cells // (len(self.columns) * self.width))
        last = len(self.trees) == self.rounds
        return _Ask(
            self.job.label, self.job.part, self.squared, self.params.get("subsample", 0.8), self.params.get("seed", 42) + len(self.trees), self.columns, self.width,
            self._numbered(self.trees), self.shares, self._numbered([self.tree])[0], self.level, [] if last else self.waiting[:most],
            self.job.early and self.level == 0 and bool(self.trees),
        )

    def _numbered(self, trees: list[Tree]) -> list[Tree]:
        """Trees over the stored columns."""
        return [Tree(t.depth, self.columns[t.feature], t.cut, t.value) for t in trees]

    def take(self, ask: _Ask, sums: np.ndarray) -> None:
        if ask.error and self._stops(sums[0] / sums[1] if sums[1] else 0.0):
            self.done = True
            return
        if not ask.nodes:
            self.done = True
            return
        parts = sums[2:].reshape(3, len(self.columns), len(ask.nodes), self.width)
        for i, node in enumerate(ask.nodes):
            self._split(node, *parts[:, :, i, :])
        self.waiting = self.waiting[len(ask.nodes) :]
        if self.waiting:
            return
        self.level, self.waiting, self.children = self.level + 1, self.children, []
        if self.level == self.depth or not self.waiting:
            self.trees.append(self.tree)
            self._next_tree()
            if len(self.trees) == self.rounds and not self.job.early:
                self.best, self.done = len(self.trees), True

    def _stops(self, error: float) -> bool:
        """After a tree: whether the held rows gained too little; the best number of trees so far is kept."""
        if len(self.trees) > 1 and self.best_error - error < self.params.get("tolerance", 0.01) * max(error, 0.01):
            return True
        if error < self.best_error or len(self.trees) == 1:
            self.best, self.best_error = len(self.trees), error
        return False

    def _split(self, node: int, wy: np.ndarray, w: np.ndarray, rows: np.ndarray) -> None:
        """The best split of a node, from sums per feature and bin; a node without one stays a leaf."""
        total, weight, many = wy[0].sum(), w[0].sum(), rows[0].sum()
        if node == 1:
            self.tree.fill(1, total / weight if weight > 0 else 0.0)
        left = [np.cumsum(x, axis=1)[:, :-1] for x in (wy, w, rows)]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[0] ** 2 / left[1] + (total - left[0]) ** 2 / (weight - left[1]) - total**2 / weight
        fewest = max(1, self.params.get("min_rows", 5))
        fits = (left[2] >= fewest) & (many - left[2] >= fewest) & (np.arange(self.width - 1) < np.array([len(c) for c in self.cuts])[:, None])
        gain = np.where(fits & np.isfinite(gain) & self._offered(node)[:, None], gain, -np.inf)
        feature, cut = np.unravel_index(np.argmax(gain), gain.shape)
        # What is left after rounding errors is no gain.
        if not gain[feature, cut] > 1e-12 * max(total**2 / weight if weight > 0 else 0.0, 1e-300):
            return
        lw, ly = left[1][feature, cut], left[0][feature, cut]
        self.tree.feature[node], self.tree.cut[node] = feature, cut
        self.tree.splits[node] = float(gain[feature, cut])
        self.tree.fill(2 * node, ly / lw)
        self.tree.fill(2 * node + 1, (total - ly) / (weight - lw))
        if self.level + 1 < self.depth:
            self.children += [2 * node, 2 * node + 1]

    def _offered(self, node: int) -> np.ndarray:
        """Whether a node may split by each column."""
        wanted, many = str(self.params.get("feature_subset", "all")), len(self.columns)
        named = {"all": many, "auto": many, "sqrt": np.ceil(np.sqrt(many)), "log2": max(1, np.ceil(np.log2(many))), "onethird": np.ceil(many / 3)}
        size = named[wanted] if wanted in named else int(wanted) if wanted.isdigit() else np.ceil(float(wanted) * many)
        if size >= many:
            return np.ones(many, bool)
        drawn = np.random.default_rng([self.params.get("seed", 42) + len(self.trees), node]).permutation(many)
        return drawn < size

    def result(self) -> Boosted:
        return Boosted(self.names, self.cuts, self.trees[: self.best], self.shares[: self.best])


def boost(store: Blocks, names: Sequence[str], jobs: Sequence[Job], judge: Callable[[DataFrame, list[int]], None] | None = None) -> tuple[list[Boosted], Bins]:
    """One model per job. Blocks hold the features ``names``, ``_weight``, labels and parts; a row of another part is left out.

    Blocks are read once for the cut points and once to be binned. ``judge`` gets ``_y`` and ``_p<i>`` of the held rows for
    the numbers of jobs, which share a label and a part.
    """
    parts = list(dict.fromkeys(j.part for j in jobs))
    others = ["_row", "_weight", *dict.fromkeys(j.label for j in jobs), *parts]
    learned = learn_bins(store, names, parts)
    done: dict[int, Boosted] = {}
    for most in dict.fromkeys(j.params.get("max_bins", 64) for j in jobs):
        bins = learned(most)
        data = binned(store, bins, others).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            own = {i: _Growing(j, bins) for i, j in enumerate(jobs) if j.params.get("max_bins", 64) == most}
            while active := [g for g in own.values() if not g.done]:
                asks = [g.ask(CELLS // len(active)) for g in active]
                for g, a, s in zip(active, asks, _add_up(data, asks, others, bins.kind), strict=True):
                    g.take(a, s)
            done |= {i: g.result() for i, g in own.items()}
            if judge is not None:
                j = jobs[0]
                with small_batches(data.sparkSession):
                    judge(predictions(data, {i: (done[i], g.columns) for i, g in own.items()}, others.index(j.label), others.index(j.part), bins.kind), list(own))
        finally:
            data.unpersist()
    return [done[i] for i in range(len(jobs))], bins
