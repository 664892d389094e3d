"""Sharding by histogram sort: cuts of the key order that make shards of nearly equal bytes.

Candidate cuts are probed by counting the exact bytes and rows of all key ranges
of one width; only ranges that hold a wanted cut are probed again with narrower
ranges, until each cut is at a boundary within the tolerance of its goal or at
the boundary nearest to it. Only then the rows move, once, to their places. All
of it is DataFrame expressions; the driver holds the counts of the probed ranges,
at most ``2 ** BITS`` for each cut.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamjobs.session import written

#: Every round narrows a range by so many bits.
BITS = 10
#: Cuts between shards are also cut into so many slices each, in which slots are numbered in parallel.
SLICES = 16


@dataclass(frozen=True)
class Cut:
    """Rows with (key, row) from here on lie above the cut; ``below`` and ``rows`` count what lies under it."""

    key: int
    row: int
    below: int
    rows: int


def _top(low: int, high: int) -> int:
    """The shift after which ``low`` to ``high`` has at most ``2 ** BITS`` values."""
    shift = 0
    while (high >> shift) - (low >> shift) >= 1 << BITS:
        shift += 1
    return shift


def find_cuts(sizes: DataFrame, parts: int, shards: int, tolerance: int, loose: float = 0.25) -> list[Cut]:
    """Cuts of (``_key``, ``_row``) into ``parts``, a multiple of ``shards``, by the sum of ``size``.

    Cuts between shards come within ``tolerance`` bytes of their goal or to the boundary nearest
    to it (the lower one of two equally near); the others may miss theirs by ``loose`` of a part.
    """
    low, high, total, n = sizes.agg(F.min("_key"), F.max("_key"), F.sum("size"), F.count(F.lit(1))).first()
    if not n:
        return []
    inner = parts // shards
    # Bytes times ``parts``, so that goals are whole numbers.
    allowed = {i: parts * tolerance if i % inner == 0 else int(loose * total) for i in range(1, parts)}
    cuts: dict[int, Cut] = {}

    def settle(ranges: list[tuple], wanted: list[int], last: bool) -> list[tuple]:
        """Settle the cuts that can be settled in ranges (start, after, below, rows below, bytes, rows).

        What is left comes back as (start, (below, rows below), cuts) of the ranges to probe again.
        """
        left: dict = {}
        for i in wanted:
            at = next((r for r in ranges if parts * r[2] <= total * i < parts * (r[2] + r[4])), ranges[-1])
            start, after, below, rows, size, count = at
            to_start, to_after = abs(total * i - parts * below), abs(parts * (below + size) - total * i)
            if min(to_start, to_after) <= allowed[i] or (last and count == 1):
                cuts[i] = Cut(*start, below, rows) if to_start <= to_after else Cut(*after, below + size, rows + count)
            else:
                left.setdefault((start, (below, rows)), []).append(i)
        return [(*at, wanted) for at, wanted in left.items()]

    def search(rows: DataFrame, column: str, highest: tuple[int, int], pending: list[tuple], places) -> list[tuple]:
        """Probe ranges of ``column`` that get narrower round by round; what is open at single values comes back."""
        shift, before = _top(*highest), None
        while pending:
            held = rows
            if before is not None:
                inside = [(F.col("_key") == k if column == "_row" else F.lit(True))
                          & (F.shiftright(column, before) == value >> before) for (k, value), _, _ in pending]
                held = rows.filter(reduce(or_, inside))
            elif column == "_row":
                held = rows.filter(F.col("_key").isin([k for (k, _), _, _ in pending]))
            key = F.col("_key") if column == "_row" else F.lit(0)
            counts = sorted(tuple(r) for r in held.groupBy(key.alias("key"), F.shiftright(column, shift).alias("bin"))
                                                  .agg(F.sum("size"), F.count(F.lit(1))).collect())
            again = []
            for (k, value), (below, n_rows), wanted in pending:
                ranges = []
                for of, bin_, size, count in counts:
                    low = bin_ << shift
                    if (column == "_row" and of != k) or (before is not None and low >> before != value >> before):
                        continue
                    ranges.append((places(k, low), places(k, (bin_ + 1) << shift), below, n_rows, size, count))
                    below, n_rows = below + size, n_rows + count
                again += settle(ranges, wanted, shift == 0)
            if shift == 0:
                return again
            pending = [((start[0], start[0] if column == "_key" else start[1]), done, wanted)
                       for start, done, wanted in again]
            before, shift = shift, max(0, shift - BITS)
        return []

    every = [((None, None), (0, 0), list(range(1, parts)))]
    hot = search(sizes, "_key", (low, high), every, lambda _, v: (v, -1))
    if hot:  # cuts inside single keys
        rows = sizes.filter(F.col("_key").isin([start[0] for start, _, _ in hot]))
        search(rows, "_row", (0, rows.agg(F.max("_row")).first()[0]), hot, lambda k, v: (k, v))
    return [cuts[i] for i in sorted(cuts)]


def _number_of(cuts: list[Cut]) -> Column:
    """How many cuts lie at or under a row, as a binary search of nested conditions."""
    def search(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        mid = (a + b) // 2
        at = cuts[mid]
        above = F.col("_key") > at.key
        if at.row >= 0:
            above = above | ((F.col("_key") == at.key) & (F.col("_row") >= at.row))
        elif -(1 << 63) <= at.key < 1 << 63:
            above = F.col("_key") >= at.key
        else:
            above = F.lit(False)
        return F.when(above, search(mid + 1, b)).otherwise(search(a, mid))

    return search(0, len(cuts))


def shard(docs: DataFrame, shards: int = 8, tolerance: int = 0, slices: int = SLICES, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row, and the columns of ``keep``.

    The law is ``bytes``: shards are runs of the order by doc_id whose bytes are nearly equal. A
    row's size is the UTF-8 bytes of its text plus 1 (a null text has none, and checksum 0). A cut
    lies at the boundary nearest to its goal, so that shards differ by less than the two rows at
    their ends; ``tolerance`` allows to end the search earlier. Null doc_ids come first; rows of one
    doc_id may lie in different shards, in the order in which they were read. Slots count from 0 in
    the order of the shard. Fewer rows than shards leave shards empty; an empty table gives no rows.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), *[F.col(c) for c in keep])
    lowest = F.lit(-(1 << 63)).cast("long")
    sizes = written(rows.withColumn("_key", F.coalesce("doc_id", lowest))
                        .withColumn("_row", F.monotonically_increasing_id()), "sizes")
    cuts = find_cuts(sizes.select("_key", "_row", "size"), shards * slices, shards, tolerance)
    placed = sizes.withColumn("_slice", _number_of(cuts))
    if cuts:
        # The rows before a slice, and before its shard, are known from the counts.
        before = [0, *(c.rows for c in cuts)]
        first = [before[i] - before[i - i % slices] for i in range(len(before))]
        offset = F.element_at(F.array(*[F.lit(v).cast("long") for v in first]), F.col("_slice") + 1)
    else:
        offset = F.lit(0)
    inside = Window.partitionBy("_slice").orderBy("_key", "_row")
    slot = F.row_number().over(inside) - 1 + offset
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
                         F.floor(F.col("_slice") / slices).cast("int").alias("shard"), slot.cast("long").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"), *keep)


#: DuckDB has no crc32: the table is built from the polynomial, and bytes are folded in one by one.
SHARD_SQL = """
WITH tab AS (
  SELECT list(list_reduce(list_prepend(i, range(8)),
              lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
s AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size, text FROM documents),
b AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS below, sum(size) OVER () AS total FROM s),
e AS (SELECT below AS edge, total FROM b UNION SELECT total, total FROM b),
cuts AS (SELECT j, arg_min(edge, {'far': abs(8 * edge - j * total), 'edge': edge}) AS edge FROM e, range(1, 8) g(j) GROUP BY j),
p AS (SELECT doc_id, size, text, (SELECT count(*) FROM cuts WHERE cuts.edge <= b.below) AS shard FROM b)
SELECT doc_id, CAST(size AS BIGINT) AS size,
  CAST(xor(list_reduce(list_prepend(4294967295,
       list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
       lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8)), 4294967295) AS BIGINT) AS text_crc32,
  'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p, tab"""
