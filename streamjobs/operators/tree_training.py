"""Regression trees of many fits trained together, one aggregate per tree level.

A fit is a target with the rows outside one fold of one repetition, or with all rows. All
fits of both kinds of model grow at the same time: a step is one Spark job in which every
task adds its rows to histograms by (fit, tree, node, feature, bin), the histograms are
summed by fit, and the best cut of every node comes back. A forest needs as many steps as
it is deep, boosting as many as rounds times depth (the first two levels of a tree in one, from pairs
of bins, where the features are few); the number of folds, repetitions, targets
and trees does not add any. What the driver holds and sends is the trees, whose size follows
from the parameters and not from the rows.

Steps are for tables of many features. Rows with the same bins, a cell, go the same way in every
tree, so a tree needs no more of them than their weight and the sum of their labels. A
table of up to ``CHUNK_ROWS`` rows is one chunk, and every fit is summed by cell, grown to its end
and scored by the one task that has it, all fits in one job. A larger table of up to ``CHUNK_ROWS / 8``
cells is summed by cell in each chunk, once for every tree, and each tree is grown to its end by the task
that gets its sums. Only larger tables of more cells need the steps.

Rows are kept in chunks of bounded size with their bins, written once to the shared folder.
A chunk is listed once per group of fits, so that a small table still gives work to all
tasks. Between steps, after every few rounds, the boosted predictions are written beside the chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from streamjobs.functions.randoms import poisson_law
from streamjobs.session import written

#: Up to so many rows, some 60 MB, are one chunk.
CHUNK_ROWS = 2_000_000
#: Rows of a chunk where trees grow by steps.
STEP_ROWS = 100_000
#: Cells of a slice that all trees of a fit score at a time.
SCORED_CELLS = 5000
#: Rows for which a tree's draws are made at a time.
DRAWN_ROWS = 100_000
#: Trees of a forest whose sums by cell go to one task.
TREES_OF_CELLS = 5
#: Cells of parts, at least, that are merged at a time.
MERGED_CELLS = 50_000
#: Trees of a forest whose histograms a task holds at a time.
TREES_AT_A_TIME = 25
#: Rounds after which boosted predictions are written.
ROUNDS_KEPT = 25
#: Up to so many bins of all features the first two levels of a boosted tree come from one step.
PAIRED_BINS = 160
#: Trees that grow at the same time; more targets are trained one batch after the other.
TREES_AT_ONCE = 30_000
FOREST, BOOSTING = "forest", "boosting"


@dataclass(frozen=True)
class Sizes:
    """What both kinds of model are made of."""

    trees: int = 100
    tree_depth: int = 10
    rounds: int = 100
    round_depth: int = 3
    rate: float = 0.1
    bins: int = 32


@dataclass(frozen=True)
class Fits:
    """All fits of some targets: every fold of every repetition, then one with all rows."""

    targets: int
    repeats: int
    folds: int

    @property
    def per_target(self) -> int:
        return self.repeats * self.folds + 1

    def __len__(self) -> int:
        return self.targets * self.per_target

    def whole(self, target: int) -> int:
        return (target + 1) * self.per_target - 1

    def target(self, fit: int) -> int:
        return fit // self.per_target

    def held_out(self, fit: int, folds: np.ndarray) -> np.ndarray:
        """Which rows a fit does not see, from each row's fold in every repetition."""
        repeat, fold = divmod(fit % self.per_target, self.folds)
        return folds[:, repeat] == fold if repeat < self.repeats else np.zeros(len(folds), bool)


def below(values: np.ndarray, feature: np.ndarray, cut: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The next node of every row in every tree: heap order, right where the value exceeds the cut; a node without feature ends."""
    by = np.take_along_axis(feature, node, 1)
    right = values[np.arange(len(values)), np.maximum(by, 0)] > np.take_along_axis(cut, node, 1)
    return np.where(by >= 0, 2 * node + 1 + right, node)


def descend(values: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Node of every row in every tree after so many levels."""
    node = np.zeros((len(feature), len(values)), np.int64)
    for _ in range(levels):
        node = below(values, feature, cut, node)
    return node


def best_cuts(weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, ...]:
    """(feature, cut, mean, mean left, mean right) per tree and node, from histograms (tree, node, feature, bin)."""
    w, s = weight.cumsum(3), total.cumsum(3)
    w_all, s_all = w[:, :, :1, -1:], s[:, :, :1, -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        left, right = s * s / w, (s_all - s) ** 2 / (w_all - w)
        gain = np.where((w > 0) & (w_all - w > 0), left + right, -np.inf)[..., :-1]
        shape = gain.shape
        flat = gain.reshape(*shape[:2], -1)
        best = flat.argmax(2)
        before = (s_all * s_all / w_all)[..., 0, 0]
        better = np.take_along_axis(flat, best[..., None], 2)[..., 0] > before + 1e-12 * (1 + np.abs(before))
        feature, cut = np.divmod(best, shape[3])
        at = (*np.indices(best.shape), feature, cut)
        means = [(s_all / w_all)[..., 0, 0], s[at] / w[at], (s_all[..., 0, 0] - s[at]) / (w_all[..., 0, 0] - w[at])]
    return (np.where(better, feature, -1).astype(np.int8), cut.astype(np.uint8), *(np.nan_to_num(m).astype(np.float64) for m in means))


class Trees:
    """Trees of all fits as arrays (fit, tree, node in heap order)."""

    def __init__(self, fits: int, trees: int, depth: int, kind=np.float64):
        shape = fits, trees, 2 ** (depth + 1) - 1
        self.depth = depth
        self.feature, self.cut = np.full(shape, -1, np.int8), np.zeros(shape, np.uint8)
        self.value = np.zeros(shape, kind)

    def grow(self, fit: int, tree: slice, level: int, cuts: tuple[np.ndarray, ...]) -> None:
        feature, cut, mean, left, right = cuts
        low = 2 ** level - 1
        nodes = slice(low, 2 * low + 1)
        self.feature[fit, tree, nodes], self.cut[fit, tree, nodes] = feature, cut
        if level == 0:
            self.value[fit, tree, nodes] = mean
        cutting = feature >= 0
        for side, means in ((1, left), (2, right)):
            children = self.value[fit, tree, 2 * low + side:4 * low + 2 + side:2]
            children[...] = np.where(cutting, means, children)


def distinct(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of ``bins``, its cells, and the cell of every row."""
    first, place = np.zeros(min(1, len(bins)), np.int64), np.zeros(len(bins), np.int64)
    for column in bins.T:
        _, first, place = np.unique(place * 256 + column, return_index=True, return_inverse=True)
    return bins[first], place


def histograms(bins: np.ndarray, node: np.ndarray, level: int, weight: np.ndarray, label: np.ndarray, n_bins: int):
    """Weights and weighted labels by (tree, node of the level, feature, bin)."""
    n_nodes, n_features = 2 ** level, bins.shape[1]
    tree, row = np.nonzero((node >= n_nodes - 1) & (weight > 0))
    base = (tree * n_nodes + node[tree, row] - (n_nodes - 1)) * n_features
    w = weight[tree, row]
    s = w * (label[tree, row] if label.ndim == 2 else label[row])
    out = np.zeros((2, len(node) * n_nodes * n_features * n_bins))
    for j in range(n_features):
        key = (base + j) * n_bins + bins[row, j]
        out[0] += np.bincount(key, w, out.shape[1])
        out[1] += np.bincount(key, s, out.shape[1])
    return out.reshape(2, len(node), n_nodes, n_features, n_bins)


def pair_histograms(bins: np.ndarray, label: np.ndarray, n_bins: int) -> np.ndarray:
    """Numbers and sums of labels by (feature, bin) and (feature, bin) of the same row."""
    places = bins.astype(np.int64) + np.arange(bins.shape[1]) * n_bins
    size = bins.shape[1] * n_bins
    key = (places[:, :, None] * size + places[:, None, :]).ravel()
    labels = np.repeat(label, bins.shape[1] ** 2)
    return np.stack([np.bincount(key, minlength=size * size), np.bincount(key, labels, size * size)]).reshape(2, 1, size, size)


def best_two_levels(pairs: np.ndarray, n_bins: int) -> tuple[np.ndarray, ...]:
    """``best_cuts`` of a root and of both its children, from the pairs of the root's rows."""
    size = pairs.shape[2]
    whole = pairs[:, :, :, :n_bins].sum(3).reshape(2, 1, 1, -1, n_bins)  # every row has one bin of the first feature
    root = best_cuts(*whole)
    low = max(int(root[0][0, 0]), 0) * n_bins
    cut = low + int(root[1][0, 0]) + 1
    sides = np.stack([pairs[:, :, low:cut].sum(2), pairs[:, :, cut:low + n_bins].sum(2)], 2).reshape(2, 1, 2, size // n_bins, n_bins)
    return tuple(np.concatenate(both, 1) for both in zip(root, best_cuts(*sides), strict=True))


_LAW = np.array(poisson_law(1.0))


def _draws(random: np.ndarray) -> np.ndarray:
    return np.searchsorted(_LAW, (random >> np.uint64(11)) / float(1 << 53), "right").astype(np.uint8)


# The draw by the first 16 bits of a random number, or _OPEN where the other bits decide.
_OPEN = 255
_FIRST = np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)
_DRAW = np.where(_draws(_FIRST) == _draws(_FIRST | np.uint64((1 << 48) - 1)), _draws(_FIRST), _OPEN).astype(np.uint8)


def bootstrap(keys: np.ndarray, fit: int, trees: range) -> np.ndarray:
    """How often each tree draws each row: Poisson numbers that depend on the row's key, the fit and the tree only."""
    seeds = np.array([fit * 1_000_003 + t for t in trees], np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    x = keys.view(np.uint64)[None, :] ^ seeds
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 1):
        x ^= x >> np.uint64(33)
        x *= np.uint64(factor)
    drawn = _DRAW[(x >> np.uint64(48)).view(np.int64)]
    rest = drawn == _OPEN
    drawn[rest] = _draws(x[rest])
    return drawn.astype(np.float64)


def drawn_sums(place: np.ndarray, n_cells: int, label: np.ndarray, keys: np.ndarray, fit: int, trees: range) -> np.ndarray:
    """Weights and weighted labels by (tree, cell)."""
    out, weight = np.zeros((2, len(trees), n_cells)), np.zeros(len(place))
    for k, tree in enumerate(trees):
        for low in range(0, len(place), DRAWN_ROWS):
            some = slice(low, low + DRAWN_ROWS)
            weight[some] = bootstrap(keys[some], fit, range(tree, tree + 1))[0]
        out[0, k] = np.bincount(place, weight, n_cells)
        out[1, k] = np.bincount(place, weight * label, n_cells)
    return out


def grow_tree(trees: Trees, tree: int, cells: np.ndarray, weight: np.ndarray, total: np.ndarray, n_bins: int) -> np.ndarray:
    """Grow a tree of the first fit from weights and weighted labels by cell; gives the node where each cell ends."""
    ends, at = np.zeros(len(cells), np.int64), np.flatnonzero(weight > 0)
    columns, w, s, node = np.ascontiguousarray(cells[at].T), weight[at], total[at], np.zeros(len(at), np.int64)
    for level in range(trees.depth):
        n_nodes, first = 2 ** level, node * n_bins
        sums = np.zeros((2, 1, n_nodes, len(columns), n_bins))
        for j, column in enumerate(columns):
            key = first + column
            for k, x in enumerate((w, s)):
                sums[k, 0, :, j] = np.bincount(key, x, n_nodes * n_bins).reshape(n_nodes, n_bins)
        cuts = best_cuts(*sums)
        trees.grow(0, slice(tree, tree + 1), level, cuts)
        by, cut = cuts[0][0][node], cuts[1][0][node]
        right, goes = columns[np.maximum(by, 0), np.arange(len(at))] > cut, by >= 0
        if not goes.all():
            ends[at[~goes]] = n_nodes - 1 + node[~goes]
            at, columns, w, s, node, right = at[goes], columns[:, goes], w[goes], s[goes], node[goes], right[goes]
        node = 2 * node + right
        if not len(at):
            break
    ends[at] = 2 ** trees.depth - 1 + node
    return ends


def grown_from_cells(kind: str, cells: np.ndarray, weight: np.ndarray, total: np.ndarray, sizes: Sizes) -> tuple[float, Trees]:
    """Boosting, with the mean label from which it starts, or some trees of a forest, from sums by (tree, cell)."""
    if kind == FOREST:
        trees = Trees(1, len(weight), sizes.tree_depth, np.float32)
        for tree in range(len(weight)):
            grow_tree(trees, tree, cells, weight[tree], total[tree], sizes.bins)
        return 0.0, trees
    trees, n = Trees(1, sizes.rounds, sizes.round_depth), weight[0].sum()
    base = float(total[0].sum() / n) if n else 0.0
    rest = total[0] - base * weight[0]
    for done in range(sizes.rounds):
        ends = grow_tree(trees, done, cells, weight[0], rest, sizes.bins)
        rest = rest - sizes.rate * trees.value[0, done][ends] * weight[0]
    return base, trees


def merged(parts: Sequence[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Cells, and weights and weighted labels by (tree, cell), of some parts of the rows together."""
    cells, place = distinct(np.concatenate([part[0] for part in parts]))
    out, low = [np.zeros((len(parts[0][1]), len(cells))) for _ in range(2)], 0
    for its, *both in parts:
        at, low = place[low:low + len(its)], low + len(its)
        for total, sums in zip(out, both, strict=True):
            total[:, at] += sums
    return cells, *out


@dataclass
class Chunk:
    """Rows of a task: bins, labels (row, target), folds (row, repetition), keys, and boosted predictions of its fits."""

    fits: range
    bins: np.ndarray
    labels: np.ndarray
    folds: np.ndarray
    keys: np.ndarray
    boosted: np.ndarray | None

    @classmethod
    def of(cls, row: dict, fits: Fits, n_features: int, groups: int) -> Chunk:
        n = row["n"]
        of_group = range(row["group"], len(fits), groups)
        boosted = np.frombuffer(row["boosted"]).reshape(-1, n) if row["boosted"] else None
        return cls(of_group, np.frombuffer(row["bins"], np.uint8).reshape(n, n_features),
                   np.frombuffer(row["labels"]).reshape(n, fits.targets), np.frombuffer(row["folds"], np.uint8).reshape(n, fits.repeats),
                   np.frombuffer(row["keys"], np.int64), boosted)

    def boosted_so_far(self, place: int, rows: np.ndarray) -> np.ndarray | float:
        """Kept predictions of the fit at a place of the group."""
        return 0.0 if self.boosted is None else self.boosted[place][rows]

    def errors(self, fits: Fits, place: int, base: float, boosting: tuple, forest: tuple, sizes: Sizes) -> Iterator[tuple[str, list[float]]]:
        """Of both kinds, over the rows that a fit did not see: their number, sums of labels and of squares, and squared error."""
        fit = self.fits[place]
        out = np.flatnonzero(fits.held_out(fit, self.folds))
        if not len(out):
            return
        label, (cells, cell) = self.labels[out, fits.target(fit)], distinct(self.bins[out])

        def leaves(trees: tuple, depth: int) -> np.ndarray:
            feature, cut, value = trees
            slices = [cells[low:low + SCORED_CELLS] for low in range(0, len(cells), SCORED_CELLS)]
            return np.concatenate([np.take_along_axis(value, descend(some, feature, cut, depth), 1).astype(np.float64).sum(0)
                                   for some in slices])[cell]

        guesses = {BOOSTING: base + self.boosted_so_far(place, out) + sizes.rate * leaves(boosting, sizes.round_depth),
                   FOREST: leaves(forest, sizes.tree_depth) / sizes.trees}
        for kind, guess in guesses.items():
            yield kind, [float(x) for x in (len(out), label.sum(), (label * label).sum(), ((label - guess) ** 2).sum())]


def binned(table: pa.Table | pa.RecordBatch, features: Sequence[str], thresholds: Sequence[np.ndarray]) -> np.ndarray:
    """Bins by (row, feature)."""
    return np.stack([np.searchsorted(t, np.asarray(table.column(c)), "left") for c, t in zip(features, thresholds, strict=True)], 1).astype(np.uint8)


def _arrow(columns: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(columns))


class Training:
    """Chunks of one batch of targets, and the steps over them."""

    def __init__(self, rows: DataFrame, features: Sequence[str], thresholds: list[np.ndarray], fits: Fits, sizes: Sizes,
                 parallelism: int):
        """``rows`` has the feature columns, ``labels`` and ``folds`` (arrays) and ``key`` (long)."""
        self.spark, self.fits, self.sizes = rows.sparkSession, fits, sizes
        self.thresholds, self.n_features = thresholds, len(features)
        self.n_rows = rows.count()
        self.by_cells = self.n_rows <= CHUNK_ROWS or self._n_cells(rows, features) <= CHUNK_ROWS // 8
        chunks = written(self._chunks(rows, features), "training-rows")
        self.n_chunks = max(1, chunks.count())
        self.groups = min(len(fits), max(1, math.ceil(2 * parallelism / self.n_chunks)))
        self.parallelism = parallelism
        listed = chunks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))))
        if self.by_cells:  # a task per chunk and group: small files would be read together
            self.work = listed.repartitionByRange(self.n_chunks * self.groups, "group", "part")
        else:
            spread = listed.repartition(min(self.n_chunks * self.groups, 2 * parallelism)) if self.groups > 1 else listed
            self.work = written(spread, "training")
        self.base = np.zeros(len(fits))
        self.boosting = Trees(len(fits), sizes.rounds, sizes.round_depth)
        self.forest = Trees(len(fits), sizes.trees, sizes.tree_depth, np.float32)
        self.kept = 0  # rounds whose predictions are in the chunks
        self.tested: dict[tuple[str, int], list[float]] | None = None  # errors by (kind, fit), once the fits are scored

    def _n_cells(self, rows: DataFrame, features: Sequence[str]) -> int:
        """Number of different bins of a row."""
        thresholds = self.thresholds

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells, _ = distinct(binned(batch, features, thresholds))
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in cells], pa.binary())], ["cell"])

        return rows.select(*features).mapInArrow(work, "cell binary").distinct().count()

    def _chunks(self, rows: DataFrame, features: Sequence[str]) -> DataFrame:
        thresholds, most = self.thresholds, CHUNK_ROWS if self.by_cells else min(CHUNK_ROWS, STEP_ROWS)
        schema = pa.schema([("n", pa.int32()), *((c, pa.binary()) for c in ("bins", "labels", "folds", "keys", "boosted")), ("part", pa.int64())])

        def pack(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            n = table.num_rows
            held = [np.array(table.column(c).combine_chunks().flatten()) for c in ("labels", "folds")]
            keys = table.column("key").to_numpy()
            blobs = (binned(table, features, thresholds), held[0].astype(np.float64), held[1].astype(np.uint8), keys)
            row = (n, *(b.tobytes() for b in blobs), None, int(keys.min()))
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema=schema)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in batches:
                for low in range(0, batch.num_rows, most):
                    piece = batch.slice(low, most)
                    if size and size + piece.num_rows > most:
                        yield pack(held)
                        held, size = [], 0
                    held.append(piece)
                    size += piece.num_rows
            if size:
                yield pack(held)

        n_parts = math.ceil(1.02 * self.n_rows / most)  # none is a little over a chunk
        dealt = rows.repartition(1) if self.n_rows <= CHUNK_ROWS else rows.repartition(n_parts, "key")
        return dealt.mapInArrow(work, "n int, bins binary, labels binary, folds binary, keys binary, boosted binary, part long")

    def _each(self, work, columns: str) -> DataFrame:
        """``work(chunk)`` for every chunk and group of fits, as rows of ``columns``."""
        fits, n_features, groups, schema = self.fits, self.n_features, self.groups, _arrow(columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    for found in work(Chunk.of(row, fits, n_features, groups), row):
                        yield pa.RecordBatch.from_pylist([found], schema=schema)

        return self.work.mapInArrow(run, columns)

    def means(self) -> None:
        """The mean label of every fit, from which boosting starts."""
        fits = self.fits

        def sums(chunk: Chunk, _):
            for fit in chunk.fits:
                label = chunk.labels[~fits.held_out(fit, chunk.folds), fits.target(fit)]
                yield {"fit": fit, "n": float(len(label)), "s": float(label.sum())}

        found = self._each(sums, "fit int, n double, s double").groupBy("fit").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        for fit, n, s in found.collect():
            self.base[fit] = s / n if n else 0.0

    def grow(self) -> None:
        """All steps of all fits."""
        if self.by_cells:
            return self._grow_by_cells()
        self.means()
        depth = self.sizes.round_depth
        paired = depth > 1 and self.n_features * self.sizes.bins <= PAIRED_BINS
        levels = [level for level in range(depth) if not (paired and level == 1)]
        for step in range(max(self.sizes.rounds * len(levels), self.sizes.tree_depth)):
            done, at = divmod(step, len(levels))
            self._step(done if done < self.sizes.rounds else None, levels[at], paired and at == 0,
                       step if step < self.sizes.tree_depth else None)
            if at == len(levels) - 1 and (done + 1) % ROUNDS_KEPT == 0 and done + 1 < self.sizes.rounds:
                self._keep(done + 1)

    def _grow_by_cells(self) -> None:
        """Sum by cell and grow every tree in one job; the trees come to the driver by way of the shared folder."""
        fits, sizes = self.fits, self.sizes
        columns = "kind string, fit int, tree int, figures array<double>, trees array<binary>"
        schema = _arrow(columns)

        def summed(chunk: Chunk, fit: int) -> Iterator[tuple[str, int, tuple[np.ndarray, ...]]]:
            """(kind, first tree, sums by cell) of a chunk's rows that the fit sees."""
            seen = np.flatnonzero(~fits.held_out(fit, chunk.folds))
            label, keys = chunk.labels[seen, fits.target(fit)], chunk.keys[seen]
            cells, place = distinct(chunk.bins[seen])
            yield BOOSTING, 0, (cells, *(np.bincount(place, x, len(cells))[None] for x in (np.ones(len(seen)), label)))
            for low in range(0, sizes.trees, TREES_OF_CELLS):
                some = range(low, min(low + TREES_OF_CELLS, sizes.trees))
                yield FOREST, low, (cells, *drawn_sums(place, len(cells), label, keys, fit, some))

        def grown(kind: str, fit: int, tree: int, sums: tuple[np.ndarray, ...]) -> tuple[dict, float, Trees]:
            base, trees = grown_from_cells(kind, *sums, sizes)
            arrays = [a[0].tobytes() for a in (trees.feature, trees.cut, trees.value)]
            return {"kind": kind, "fit": fit, "tree": tree, "figures": [base], "trees": arrays}, base, trees

        def whole(chunk: Chunk, _) -> Iterator[dict]:
            """Trees, and errors as trees of number -1."""
            for place, fit in enumerate(chunk.fits):
                bases, kinds = {}, {BOOSTING: [], FOREST: []}
                for kind, tree, sums in summed(chunk, fit):
                    row, base, trees = grown(kind, fit, tree, sums)
                    bases[kind] = base
                    kinds[kind].append(trees)
                    yield row
                joined = {kind: tuple(np.concatenate([getattr(t, a)[0] for t in trees]) for a in ("feature", "cut", "value"))
                          for kind, trees in kinds.items()}
                for kind, sums in chunk.errors(fits, place, bases[BOOSTING], joined[BOOSTING], joined[FOREST], sizes):
                    yield {"kind": kind, "fit": fit, "tree": -1, "figures": sums, "trees": []}

        def parts(chunk: Chunk, row: dict) -> Iterator[dict]:
            for fit in chunk.fits:
                for kind, tree, (cells, weight, total) in summed(chunk, fit):
                    yield {"kind": kind, "fit": fit, "tree": tree, "part": row["part"], "n": len(cells),
                           "sums": [cells.tobytes(), weight.astype(np.uint32).tobytes(), total.tobytes()]}

        n_features = self.n_features

        def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, held = None, []
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    n, (cells, weight, total), key = row["n"], row["sums"], (row["kind"], row["fit"], row["tree"])
                    if held and key != current:
                        yield pa.RecordBatch.from_pylist([grown(*current, merged(held))[0]], schema=schema)
                        held = []
                    current = key
                    held.append((np.frombuffer(cells, np.uint8).reshape(n, n_features),
                                 np.frombuffer(weight, np.uint32).reshape(-1, n), np.frombuffer(total).reshape(-1, n)))
                    if sum(len(part[0]) for part in held[1:]) > max(MERGED_CELLS, len(held[0][0])):
                        held = [merged(held)]
            if held:
                yield pa.RecordBatch.from_pylist([grown(*current, merged(held))[0]], schema=schema)

        if self.n_chunks == 1:
            found = self._each(whole, columns)
            self.tested = {}
        else:
            keys = "kind", "fit", "tree"
            sums = self._each(parts, "kind string, fit int, tree int, part long, n int, sums array<binary>")
            dealt = sums.repartition(max(2 * self.parallelism, len(fits) * math.ceil(self.n_rows / CHUNK_ROWS)), *keys)
            found = dealt.sortWithinPartitions(*keys, "part").mapInArrow(together, columns)
        for kind, fit, tree, figures, blobs in written(found, "trees").toLocalIterator():
            if tree < 0:
                self.tested[kind, fit] = figures
                continue
            trees = self.boosting if kind == BOOSTING else self.forest
            for held, blob in zip((trees.feature, trees.cut, trees.value), blobs, strict=True):
                got = np.frombuffer(blob, held.dtype).reshape(-1, held.shape[2])
                held[fit, tree:tree + len(got)] = got
            if kind == BOOSTING:
                self.base[fit], = figures

    def _recent(self, upto: int):
        """Boosted trees that are not yet in the chunks' predictions."""
        now = slice(self.kept, upto)
        return self.boosting.feature[:, now], self.boosting.cut[:, now], self.boosting.value[:, now]

    def _step(self, done: int | None, level: int, paired: bool, forest_level: int | None) -> None:
        fits, sizes, n_features = self.fits, self.sizes, self.n_features
        known = 2 ** (forest_level or 0) - 1
        sent = self.spark.sparkContext.broadcast((
            self.base, self._recent((done or 0) + 1) if done is not None else None,
            (self.forest.feature[:, :, :max(known, 1)], self.forest.cut[:, :, :max(known, 1)]) if forest_level is not None else None))

        columns = "kind string, fit int, tree int, parts array<binary>"
        schema = _arrow(columns)

        def grown(chunk: Chunk, _):
            base, boosted, forest = sent.value
            for place, fit in enumerate(chunk.fits):
                seen = np.flatnonzero(~fits.held_out(fit, chunk.folds))
                bins, label = chunk.bins[seen], chunk.labels[seen, fits.target(fit)]
                if boosted is not None:
                    feature, cut, value = (a[fit] for a in boosted)
                    rest = label - base[fit] - chunk.boosted_so_far(place, seen)
                    if len(feature) > 1:
                        leaf = descend(bins, feature[:-1], cut[:-1], sizes.round_depth)
                        rest = rest - sizes.rate * np.take_along_axis(value[:-1], leaf, 1).sum(0)
                    if paired:
                        yield found(BOOSTING, fit, 0, pair_histograms(bins, rest, sizes.bins))
                    else:
                        node = descend(bins, feature[-1:], cut[-1:], level)
                        yield found(BOOSTING, fit, 0, histograms(bins, node, level, np.ones(node.shape), rest, sizes.bins))
                for low in range(0, sizes.trees if forest is not None else 0, TREES_AT_A_TIME):
                    some = range(low, min(low + TREES_AT_A_TIME, sizes.trees))
                    node = descend(bins, forest[0][fit, some.start:some.stop], forest[1][fit, some.start:some.stop], forest_level)
                    drawn = bootstrap(chunk.keys[seen], fit, some)
                    yield found(FOREST, fit, low, histograms(bins, node, forest_level, drawn, label, sizes.bins))

        def found(kind: str, fit: int, tree: int, sums: np.ndarray) -> dict:
            flat = sums.reshape(2, -1)
            keys = np.flatnonzero(flat[0])
            return {"kind": kind, "fit": fit, "tree": tree, "parts": [keys.tobytes(), flat[0][keys].tobytes(), flat[1][keys].tobytes()]}

        def cuts(kind: str, fit: int, tree: int, sums: np.ndarray) -> dict:
            best = best_two_levels(sums, sizes.bins) if paired and kind == BOOSTING else best_cuts(*sums)
            return {"kind": kind, "fit": fit, "tree": tree, "parts": [a.tobytes() for a in best]}

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, total = None, None
            for batch in batches:
                for row in batch.to_pylist():
                    key = row["kind"], row["fit"], row["tree"]
                    if key != current:
                        if current:
                            yield pa.RecordBatch.from_pylist([cuts(*current, total)], schema=schema)
                        if row["kind"] == BOOSTING:
                            shape = (1, *[n_features * sizes.bins] * 2) if paired else (1, 2 ** level, n_features, sizes.bins)
                        else:
                            shape = min(TREES_AT_A_TIME, sizes.trees - row["tree"]), 2 ** forest_level, n_features, sizes.bins
                        current, total = key, np.zeros((2, *shape))
                    flat, (keys, w, s) = total.reshape(2, -1), row["parts"]
                    at = np.frombuffer(keys, np.int64)
                    flat[0][at] += np.frombuffer(w)
                    flat[1][at] += np.frombuffer(s)
            if current:
                yield pa.RecordBatch.from_pylist([cuts(*current, total)], schema=schema)

        keys = ("kind", "fit", "tree")
        parts = self._each(grown, columns).repartition(2 * self.parallelism, *keys).sortWithinPartitions(*keys).mapInArrow(summed, columns)
        for kind, fit, tree, blobs in parts.collect():
            some = 1 if kind == BOOSTING else min(TREES_AT_A_TIME, sizes.trees - tree)
            arrays = [np.frombuffer(b, t).reshape(some, -1) for b, t in
                      zip(blobs, (np.int8, np.uint8, np.float64, np.float64, np.float64), strict=True)]
            if kind == BOOSTING:
                for at in (0, 1) if paired else (level,):
                    nodes = slice(2 ** at - 1, 2 ** (at + 1) - 1) if paired else slice(None)
                    self.boosting.grow(fit, slice(done, done + 1), at, [a[:, nodes] for a in arrays])
            else:
                self.forest.grow(fit, slice(tree, tree + some), forest_level, arrays)
        sent.destroy()

    def _keep(self, upto: int) -> None:
        """Write the boosted predictions of all rounds so far beside the chunks."""
        sizes, sent = self.sizes, self.spark.sparkContext.broadcast(self._recent(upto))

        def added(chunk: Chunk, row: dict):
            feature, cut, value = sent.value
            more = np.stack([np.take_along_axis(value[fit], descend(chunk.bins, feature[fit], cut[fit], sizes.round_depth), 1).sum(0)
                             for fit in chunk.fits])
            before = 0.0 if chunk.boosted is None else chunk.boosted
            yield row | {"boosted": (before + sizes.rate * more).tobytes()}

        self.work = written(self._each(added, ", ".join(f"{c} {t}" for c, t in self.work.dtypes)), "training")
        self.kept = upto
        sent.destroy()

    def scores(self) -> list[tuple[str, int, float]]:
        """(kind, fit, R²) of every fold, on the rows that its fit did not see; NaN where there is no score."""
        found = self._errors() if self.tested is None else self.tested
        spread = {key: ss - s ** 2 / n for key, (n, s, ss, _) in found.items()}
        return [(*key, 1 - sums[3] / v if (v := spread[key]) > 1e-12 else math.nan) for key, sums in found.items()]

    def _errors(self) -> dict[tuple[str, int], list[float]]:
        fits, sizes = self.fits, self.sizes
        sent = self.spark.sparkContext.broadcast((self.base, self._recent(sizes.rounds),
                                                  (self.forest.feature, self.forest.cut, self.forest.value)))
        names = "n", "s", "ss", "error"

        def tested(chunk: Chunk, _):
            base, *both = sent.value
            for place, fit in enumerate(chunk.fits):
                boosting, forest = (tuple(a[fit] for a in trees) for trees in both)
                for kind, sums in chunk.errors(fits, place, base[fit], boosting, forest, sizes):
                    yield {"kind": kind, "fit": fit} | dict(zip(names, sums, strict=True))

        sums = [F.sum(c).alias(c) for c in names]
        rows = self._each(tested, "kind string, fit int, n double, s double, ss double, error double").groupBy("kind", "fit").agg(*sums).collect()
        sent.destroy()
        return {(r["kind"], r["fit"]): [r[c] for c in names] for r in rows}

    def model(self, kind: str, target: int, features: Sequence[str]) -> TreeModel:
        """The model of all rows."""
        fit = self.fits.whole(target)
        trees = self.boosting if kind == BOOSTING else self.forest
        feature, cut = trees.feature[fit].astype(np.int64), trees.cut[fit].astype(np.int64)
        longest = max((len(t) for t in self.thresholds), default=0) or 1
        table = np.array([np.pad(t, (0, longest - len(t)), constant_values=np.inf) for t in self.thresholds])
        threshold = np.where(feature >= 0, table[np.maximum(feature, 0), np.minimum(cut, longest - 1)], 0.0)
        return TreeModel(kind, list(features), feature, threshold, trees.value[fit].astype(np.float64), trees.depth,
                         float(self.base[fit]) if kind == BOOSTING else 0.0, self.sizes.rate if kind == BOOSTING else 1 / self.sizes.trees)


@dataclass
class TreeModel:
    """Trees whose leaf values, times ``scale``, are added to ``base``; saved as a table of nodes."""

    kind: str
    features: list[str]
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int
    base: float
    scale: float

    def predict(self, values: np.ndarray) -> np.ndarray:
        leaf = descend(values, self.feature, self.threshold, self.depth)
        return self.base + self.scale * np.take_along_axis(self.value, leaf, 1).sum(0)

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """``df`` with the prediction; the same on a stream."""
        predict = self.predict

        def batch(*columns: pd.Series) -> pd.Series:
            return pd.Series(predict(np.stack([c.to_numpy(np.float64) for c in columns], 1)))

        udf = F.pandas_udf(batch, "double")
        return df.withColumn(name, udf(*[F.col(c).cast("double") for c in self.features]))

    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes as Parquet: tree, node, feature (-1 in a leaf), threshold, value, and the model's figures in each row."""
        trees, nodes = self.feature.shape
        reached = np.zeros((trees, nodes), bool)
        reached[:, 0] = True
        for node in range(nodes // 2):
            into = reached[:, node] & (self.feature[:, node] >= 0)
            reached[:, 2 * node + 1] |= into
            reached[:, 2 * node + 2] |= into
        tree, node = np.nonzero(reached)
        table = pa.table({"tree": tree, "node": node, "feature": self.feature[tree, node], "threshold": self.threshold[tree, node],
                          "value": self.value[tree, node]})
        rows = spark.createDataFrame(table)
        figures = {"kind": self.kind, "features": self.features, "depth": self.depth, "base": self.base, "scale": self.scale}
        rows.withColumns({k: F.lit(v) for k, v in figures.items()}).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeModel:
        table = spark.read.parquet(path).toArrow()
        first = table.slice(0, 1).to_pylist()[0]
        tree, node = table.column("tree").to_numpy(), table.column("node").to_numpy()
        shape = int(tree.max()) + 1, 2 ** (first["depth"] + 1) - 1
        arrays = [np.full(shape, -1, np.int64), np.zeros(shape), np.zeros(shape)]
        for array, column in zip(arrays, ("feature", "threshold", "value"), strict=True):
            array[tree, node] = table.column(column).to_numpy()
        return cls(first["kind"], list(first["features"]), *arrays, first["depth"], first["base"], first["scale"])
