"""Exact top-k inner products by best-first search in an M-tree.

Inner products become distances when every vector x gets one more component,
sqrt(M - |x|^2) with M the largest squared length: then |q - x|^2 = |q|^2 + M - 2 <q, x>,
and the closest vectors are those of the largest inner product.

The tree grows with the table. The root page has at most ``FANOUT`` routing objects, a bounded
draw of the vectors, and each vector goes to the nearest one. An entry of more than ``SUBTREE``
vectors gets inner routing objects, one for about ``SUBTREE`` vectors, drawn from its own, and
its vectors go to the nearest of those; so a subtree is a ball of its own, with its covering
radius. A ball that is still too full (copies, or a dense spot) is dealt into pieces by hash.
What the driver holds is one routing object per ``SUBTREE`` vectors.

A task builds the pages of a piece (routing object, covering radius, distance to the parent,
and for every entry its distance to the routing object) and runs a slice of at most about
``QUERIES`` of the queries that visit it. A page whose distance cannot matter by the stored
parent distance is never compared, nor an entry by its own. Every query opens its pages from the
nearest on; queries that stand at the same page are scored together as one matrix product.
Queries first visit a piece of the nearest ball; with the bound from there they go only to
balls that may still hold something better.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamjobs.llm.words import in_batches
from streamjobs.session import written

FANOUT, SUBTREE, PAGE = 32, 32_768, 256
#: Queries that one task runs against a piece, about; more go to further tasks, with the piece.
QUERIES = 8192
_TOGETHER = 512  # queries that open their pages in step
_EXACT = 2.0 ** 52  # up to here float64 sums of integer products are exact
_LONG = (1 << 63) - 1


def whole_components(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component; null if the vector or a component is null or not finite."""
    values = F.transform(embedding, lambda x: x.cast("double"))
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(values, lambda x: F.floor(x * scale)))


def _matrix(column, dim: int, kind) -> np.ndarray:
    """Vectors of an Arrow list column as rows of ``dim`` components, shorter ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(ends)
    flat = flat[ends[0]:ends[-1]] if len(ends) > 1 else flat[:0]
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out.astype(kind)


def _filled(vectors: list, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


class Space:
    """The metric: vectors with the additional component, and scores from distances."""

    def __init__(self, largest: float, dim: int):
        self.largest, self.dim = largest, dim
        self.kind = np.float64 if largest < _EXACT else object  # whole numbers beyond are exact as Python has them

    def points(self, vectors: np.ndarray) -> np.ndarray:
        floats = vectors.astype(np.float64)
        rest = np.sqrt(np.maximum(0.0, self.largest - (floats ** 2).sum(axis=1)))
        return np.concatenate([floats, rest[:, None]], axis=1)

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        floats = vectors.astype(np.float64)
        return np.concatenate([floats, np.zeros((len(floats), 1))], axis=1)

    def reach(self, length2: float, score: float) -> float:
        """Distance at which a score lies, with room for rounding."""
        distance = np.sqrt(max(0.0, length2 + self.largest - 2.0 * score))
        return distance + 1e-6 * (1.0 + distance + np.sqrt(self.largest + length2))


def distances(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    square = (rows ** 2).sum(axis=1)[:, None] + (to ** 2).sum(axis=1)[None, :] - 2.0 * rows @ to.T
    return np.sqrt(np.maximum(0.0, square))


class Subtree:
    """Pages of one subtree below ``parent``, a routing object of the root page."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, parent: np.ndarray, space: Space):
        self.space, self.parent = space, parent
        points = space.points(vectors)
        order = np.argsort(ids, kind="stable")
        ids, vectors, points = ids[order], vectors[order], points[order]
        step = max(1, len(ids) // max(1, len(ids) // PAGE))
        routing = points[::step]
        nearest, away = np.empty(len(ids), np.int64), np.empty(len(ids))
        for low in range(0, len(ids), 2048):
            d = distances(points[low:low + 2048], routing)
            nearest[low:low + 2048] = d.argmin(axis=1)
            away[low:low + 2048] = d[np.arange(len(d)), d.argmin(axis=1)]
        self.pages = []
        for r in np.unique(nearest):
            members = np.flatnonzero(nearest == r)
            members = members[np.argsort(away[members], kind="stable")]
            for low in range(0, len(members), PAGE):
                held = members[low:low + PAGE]
                self.pages.append((routing[r], away[held], ids[held], vectors[held]))
        self.routing = np.array([p[0] for p in self.pages])
        self.radius = np.array([p[1].max() for p in self.pages]) + 1e-6 * (1 + np.sqrt(space.largest))
        self.to_parent = distances(self.routing, parent[None, :])[:, 0]

    def search(self, own: int, query: np.ndarray, length2: float, to_parent: float, k: int, bound) -> list[tuple[int, int]]:
        """The ``k`` best (score, id) that reach ``bound``; ``own`` is left out."""
        space, best, floor = self.space, [], bound  # best: heap of (score, -id), the worst first
        point = np.append(query.astype(np.float64), 0.0)
        reach = np.inf if floor is None else space.reach(length2, floor)
        # Lower bounds from the distances to the parent, without a comparison with any page.
        queue = [(low, False, page) for page, low in enumerate((np.abs(to_parent - self.to_parent) - self.radius).tolist())
                 if low <= reach]
        heapq.heapify(queue)
        while queue:
            low, compared, page = heapq.heappop(queue)
            if low > reach:
                break
            routing, away, ids, vectors = self.pages[page]
            d = float(np.linalg.norm(point - routing))
            if not compared:
                low = max(low, d - self.radius[page])
                if low <= reach:
                    heapq.heappush(queue, (low, True, page))
                continue
            near = np.flatnonzero(np.abs(d - away) <= reach)  # the others are too far by their stored distance
            scores = vectors[near] @ query
            if floor is not None:
                near, scores = near[scores >= floor], scores[scores >= floor]
            for score, vec_id in zip(scores.tolist(), ids[near].tolist(), strict=True):
                if vec_id == own:
                    continue
                item = (int(score), -vec_id)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k and (floor is None or best[0][0] > floor):
                floor = best[0][0]
                reach = space.reach(length2, floor)
        return [(score, -minus) for score, minus in best]


    def search_all(self, own: np.ndarray, queries: np.ndarray, to_parent: np.ndarray, k: int, bounds: list):
        """(query, id, score) of the ``k`` best of each query that reach its bound; every query opens its nearest page first."""
        if self.space.kind is object:
            for query_id, query, d, bound in zip(own.tolist(), queries, to_parent.tolist(), bounds, strict=True):
                length2 = float((query.astype(np.float64) ** 2).sum())
                for score, vec_id in self.search(query_id, query, length2, d, k, bound):
                    yield query_id, vec_id, score
            return
        for low in range(0, len(own), _TOGETHER):
            part = slice(low, low + _TOGETHER)
            yield from self._search_together(own[part], queries[part], to_parent[part], k, bounds[part])

    def _search_together(self, own: np.ndarray, queries: np.ndarray, to_parent: np.ndarray, k: int, bounds: list):
        space, best = self.space, [[] for _ in own]  # heaps of (score, -id), the worst first
        length2 = (queries ** 2).sum(axis=1)
        floor = np.array([-np.inf if b is None else float(b) for b in bounds])
        reach = np.array([np.inf if b is None else space.reach(n, b) for n, b in zip(length2.tolist(), bounds, strict=True)])
        # Lower bounds from the distances to the parent; only pages that some query may need are compared.
        least = np.abs(to_parent[:, None] - self.to_parent[None, :]) - self.radius[None, :]
        asked = np.flatnonzero((least <= reach[:, None]).any(axis=0))
        if not len(asked):
            return
        away_from = distances(space.queries(queries), self.routing[asked])
        least = np.maximum(least[:, asked], away_from - self.radius[asked][None, :])
        waiting = np.arange(len(own))
        while len(waiting):
            page = least[waiting].argmin(axis=1)
            open_ = (least[waiting, page] <= reach[waiting]) & np.isfinite(least[waiting, page])
            waiting, page = waiting[open_], page[open_]
            least[waiting, page] = np.inf
            for at in np.unique(page):
                group = waiting[page == at]
                _, away, ids, vectors = self.pages[asked[at]]
                gap = np.abs(away_from[group, at][:, None] - away[None, :]) <= reach[group][:, None]
                near = np.flatnonzero(gap.any(axis=0))  # the others are too far by their stored distance
                if not len(near):
                    continue
                scores = queries[group] @ vectors[near].T
                wanted = (scores >= floor[group][:, None]) & (ids[near][None, :] != own[group][:, None])
                if len(near) > k + 1:  # of one page no more than its k best and those that tie can count, and the query itself
                    wanted &= scores >= np.partition(scores, -k - 1, axis=1)[:, -k - 1][:, None]
                for g, n in zip(*(a.tolist() for a in np.nonzero(wanted)), strict=True):
                    query, item = group[g], (int(scores[g, n]), -int(ids[near[n]]))
                    held = best[query]
                    if len(held) < k:
                        heapq.heappush(held, item)
                    elif item > held[0]:
                        heapq.heapreplace(held, item)
                for query in group.tolist():
                    if len(best[query]) == k and best[query][0][0] > floor[query]:
                        floor[query] = best[query][0][0]
                        reach[query] = space.reach(length2[query], floor[query])
        for query_id, held in zip(own.tolist(), best, strict=True):
            for score, minus in held:
                yield query_id, -minus, score


_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Balls:
    """Root page and inner routing objects: for every ball its routing object, covering radius, pieces and root entry."""

    def __init__(self, root: np.ndarray, inner: dict[int, np.ndarray]):
        self.root = root
        self.of = [inner.get(e, root[e:e + 1]) for e in range(len(root))]
        self.first = np.concatenate([[0], np.cumsum([len(b) for b in self.of])])
        self.routing = np.concatenate(self.of)
        self.radius, self.pieces = np.zeros(len(self.routing)), np.zeros(len(self.routing), np.int64)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ball of every vector, by way of its root entry, and the distance to its routing object."""
        entry = distances(points, self.root).argmin(axis=1)
        ball, away = np.empty(len(points), np.int64), np.empty(len(points))
        for e in np.unique(entry):
            rows = np.flatnonzero(entry == e)
            d = distances(points[rows], self.of[e])
            best = d.argmin(axis=1)
            ball[rows], away[rows] = self.first[e] + best, d[np.arange(len(rows)), best]
        return ball, away

    def visits(self, queries: np.ndarray, reach: np.ndarray | None):
        """(query, ball, piece) arrays: one home each without ``reach``, else all that a query may need but for its home."""
        held = np.flatnonzero(self.pieces > 0)
        d = distances(queries, self.root)
        covers = np.array([(self.radius[a:b] + distances(self.routing[a:b], self.root[e:e + 1])[:, 0])[self.pieces[a:b] > 0].max(initial=-np.inf)
                           for e, (a, b) in enumerate(zip(self.first[:-1], self.first[1:], strict=True))])
        closest = d - covers[None, :]
        home_entry = np.where(np.isinf(covers)[None, :], np.inf, closest).argmin(axis=1)
        home = np.empty(len(queries), np.int64)
        for e in np.unique(home_entry):
            rows, own = np.flatnonzero(home_entry == e), held[(held >= self.first[e]) & (held < self.first[e + 1])]
            low = distances(queries[rows], self.routing[own]) - self.radius[own][None, :]
            home[rows] = own[low.argmin(axis=1)]
        if reach is None:
            yield np.arange(len(queries)), home, np.zeros(len(queries), np.int64)
            return
        for e in range(len(self.root)):
            own = held[(held >= self.first[e]) & (held < self.first[e + 1])]
            rows = np.flatnonzero(closest[:, e] <= reach)
            if not len(own) or not len(rows):
                continue
            low = distances(queries[rows], self.routing[own]) - self.radius[own][None, :]
            at, which = np.nonzero(low <= reach[rows][:, None])
            query, ball = rows[at], own[which]
            times = self.pieces[ball]
            piece = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            query, ball = np.repeat(query, times), np.repeat(ball, times)
            other = ~((ball == home[query]) & (piece == 0))
            yield query[other], ball[other], piece[other]


def _searched(points: DataFrame, visits: DataFrame, balls: Balls, space: Space, k: int) -> DataFrame:
    """Candidates of the queries' visits. ``points``: ball, piece, vec_id, v; ``visits``: these and bound."""
    shared = points.sparkSession.sparkContext.broadcast((balls, space))  # a routing object per SUBTREE vectors
    slices = visits.groupBy("ball", "piece").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("slices"))
    place = ["ball", "piece", "slice"]
    rows = (points.join(slices, ["ball", "piece"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
                  .select(*place, F.lit(0).alias("kind"), "vec_id", "v", F.lit(None).cast("long").alias("bound")))
    asked = visits.join(slices, ["ball", "piece"]).withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.col("slices")).cast("int"))
    rows = rows.unionByName(asked.select(*place, F.lit(1).alias("kind"), "vec_id", "v", "bound"))

    def run(batches):
        known, metric = shared.value

        def each():
            current, ids, vectors, tree = None, [], [], None
            for batch in batches:
                keys = np.stack([batch.column(c).to_numpy() for c in (*place, "kind")], axis=1)
                cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                    *key, kind = keys[a].tolist()
                    part = batch.slice(a, b - a)
                    if key != current:
                        current, ids, vectors, tree = key, [], [], None
                    found = _matrix(part.column("v"), metric.dim, metric.kind)
                    if kind == 0:
                        ids.append(part.column("vec_id").to_numpy())
                        vectors.append(found)
                        continue
                    if tree is None and ids:
                        tree = Subtree(np.concatenate(ids), np.concatenate(vectors), known.routing[key[0]], metric)
                        ids, vectors = [], []
                    if tree is None:
                        continue
                    to_parent = distances(metric.queries(found), known.routing[key[0]][None, :])[:, 0]
                    for own, vec_id, score in tree.search_all(part.column("vec_id").to_numpy(), found, to_parent, k,
                                                              part.column("bound").to_pylist()):
                        yield own, vec_id, max(-_LONG - 1, min(_LONG, score))

        return in_batches(each(), _HITS, size=20_000)

    dealt = rows.repartition(*place).sortWithinPartitions(*place, "kind")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score long")


def top_inner_products(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of the rows whose vec_id is divisible by ``every``.

    ``vectors`` has ``vec_id`` and ``embedding``; components are floor(``scale`` * x). Candidates are
    all rows but the query's own; equal scores go to the smaller vec_id, and a query with fewer
    than ``k`` candidates gets them all. Rows without vec_id, and vectors that are null or hold null or
    non-finite components take no part; of rows that repeat a vec_id the smallest vector counts.
    Vectors of other lengths are filled up with zeros. Scores beyond
    64 bits are cut to the nearest that fits. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    valid = vectors.select(F.col("vec_id").cast("long"), whole_components(F.col("embedding"), scale).alias("v"))
    points = written(valid.dropna().groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    largest, dim = points.agg(F.max(square), F.max(F.size("v"))).first()
    if largest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    space = Space(largest, dim)
    draw = points.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(FANOUT).collect()
    root = space.points(np.unique(_filled([row["v"] for row in draw], dim), axis=0))

    def routed(balls: Balls) -> DataFrame:
        """Vectors with their ball and their distance to its routing object."""
        shared = spark.sparkContext.broadcast((balls, space))

        def run(batches):
            known, metric = shared.value
            for batch in batches:
                ball, away = known.nearest(metric.points(_matrix(batch.column("v"), metric.dim, metric.kind)))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(ball), pa.array(away)],
                                                 names=["vec_id", "v", "ball", "away"])

        return points.mapInArrow(run, "vec_id long, v array<long>, ball long, away double")

    def measured(df: DataFrame) -> list:
        return df.groupBy("ball").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()

    balls = Balls(root, {})
    dealt = written(routed(balls), "routed")
    sizes = measured(dealt)
    full = [r["ball"] for r in sizes if r["n"] > SUBTREE]
    if full:
        share = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(SUBTREE)) == 0
        inner: dict[int, list] = {}
        for row in dealt.filter(share & F.col("ball").isin(full)).select("ball", "v").collect():
            inner.setdefault(row["ball"], []).append(row["v"])
        balls = Balls(root, {e: space.points(np.unique(_filled(v, dim), axis=0)) for e, v in inner.items()})
        dealt = written(routed(balls), "routed")
        sizes = measured(dealt)
    for ball, n, radius in sizes:
        balls.radius[ball], balls.pieces[ball] = radius * (1 + 1e-9) + 1e-6 * (1 + np.sqrt(largest)), -(-n // (2 * SUBTREE))
    pieces = spark.createDataFrame([(ball, int(balls.pieces[ball])) for ball, *_ in sizes], "ball long, pieces int")
    tree = dealt.join(pieces, "ball").select("vec_id", "v", "ball", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).alias("piece"))
    queries = points.filter(F.col("vec_id") % every == 0)
    shared = spark.sparkContext.broadcast((balls, space))

    def visited(first: bool):
        def run(batches):
            known, metric = shared.value
            for whole in batches:
                for low in range(0, whole.num_rows, 256):
                    batch = whole.slice(low, 256)
                    found = _matrix(batch.column("v"), metric.dim, metric.kind)
                    reach = None
                    if not first:
                        length2 = (found.astype(np.float64) ** 2).sum(axis=1)
                        reach = np.array([np.inf if b is None else metric.reach(n, b) for n, b in
                                          zip(length2.tolist(), batch.column("bound").to_pylist(), strict=True)])
                    for at, ball, piece in known.visits(metric.queries(found), reach):
                        for cut in range(0, len(at), 4096):
                            part = slice(cut, cut + 4096)
                            kept = batch.take(pa.array(at[part]))
                            yield pa.RecordBatch.from_arrays(
                                [kept.column("vec_id"), kept.column("v"), kept.column("bound"), pa.array(ball[part]), pa.array(piece[part])],
                                names=["vec_id", "v", "bound", "ball", "piece"])

        return run

    ddl = "vec_id long, v array<long>, bound long, ball long, piece long"
    asked = queries.withColumn("bound", F.lit(None).cast("long"))
    near = written(_searched(tree, asked.mapInArrow(visited(True), ddl), balls, space, k), "first-visits")
    bounds = (near.groupBy("query_id").agg(F.min("score").alias("_least"), F.count(F.lit(1)).alias("_n"))
                  .filter(F.col("_n") >= k).select("query_id", F.col("_least").alias("bound")))
    bounded = queries.join(bounds, queries["vec_id"] == bounds["query_id"], "left").select("vec_id", "v", "bound")
    rest = _searched(tree, bounded.mapInArrow(visited(False), ddl), balls, space, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (near.unionByName(rest).withColumn("rank", rank).filter(F.col("rank") <= k)
                .select("query_id", "rank", "vec_id", "score"))


TOP_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""
