"""Periodic runs in texts: stretches in which the words repeat with a period, four times over at least.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are
equal), of at least ``max(6, 4 * q)`` words, that no neighbouring word extends keeping the
period. Words after a run's first ``q`` words are its repeats.

Method, per text: every three-word window inside a run occurs three times or more, so only
stretches of such windows are looked at; in ordinary prose hardly any are left. Their
suffixes are sorted (prefix doubling) and neighbours in that order get their longest common
prefix (LCP). Then Kruskal's way: suffix classes are united by decreasing LCP with
union-find, each class an ordered set of positions, the smaller set moved into the larger.
Two positions that become neighbours in a set, at a distance ``d`` within the LCP, seed a
run of period ``d``: the windows at the smaller position repeat ``d`` further on for LCP
windows. The leftmost pair of a run is united first, later pairs fail the look at the word
before, so every run is seeded once, with its smallest period: a multiple of it is never the
distance of neighbours, because the position in between has a longer LCP.

Each text is worked on for itself inside the scan's task: no shuffle, no key, memory in
proportion to the longest text. Defined results: null and empty texts have no words, no runs
and an empty collapsed text; repeated rows and null ids are worked on row by row; an empty
table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from streamjobs.llm.word_numbers import numbered, windows_of_three
from streamjobs.llm.words import in_batches, words_of

SPACE = "[\\x20\\x09-\\x0D]+"
_BLOCK = 2048
_RUNS = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUNS_ARROW = [("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
               ("collapsed", pa.string())]


class Places:
    """An ordered set of positions in blocks, so that a member is added to a large set without moving all of it."""

    def __init__(self, place: int):
        self.blocks, self.firsts, self.size = [[place]], [place], 1

    def add(self, place: int) -> tuple[int, int]:
        """Add a position; its neighbours before and after it, -1 where there is none."""
        b = max(bisect_right(self.firsts, place) - 1, 0)
        block = self.blocks[b]
        i = bisect_right(block, place)
        before = block[i - 1] if i else -1  # only in block 0 can a position come before the block's first
        after = block[i] if i < len(block) else self.firsts[b + 1] if b + 1 < len(self.blocks) else -1
        block.insert(i, place)
        self.firsts[b] = block[0]
        if len(block) > 2 * _BLOCK:
            self.blocks[b:b + 1] = [block[:_BLOCK], block[_BLOCK:]]
            self.firsts.insert(b + 1, block[_BLOCK])
        self.size += 1
        return before, after

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a sequence in order, and the LCP of each with the next one, by prefix doubling."""
    n, width = len(codes), 1
    ranks = [np.unique(codes, return_inverse=True)[1].astype(np.int32)]
    while ranks[-1].max() < n - 1:
        key = ranks[-1].astype(np.int64) * (n + 1)
        key[:n - width] += ranks[-1][width:] + 1
        ranks.append(np.unique(key, return_inverse=True)[1].astype(np.int32))
        width *= 2
    order = np.empty(n, np.int64)
    order[ranks[-1]] = np.arange(n)
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    for rank in reversed(ranks[:-1]):
        width = max(width // 2, 1)
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[rank[a[inside]] == rank[b[inside]]]
        for moved in (a, b, lcp):
            moved[same] += width
    return order, lcp


def seeds(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(position, LCP, distance) of every left-most pair of positions that repeat within their LCP."""
    order, lcp = suffix_order(codes)
    by_lcp = np.argsort(-lcp, kind="stable")
    by_lcp = by_lcp[lcp[by_lcp] > 0].tolist()
    order, lcp, codes = order.tolist(), lcp.tolist(), codes.tolist()
    parent, sets, found = {}, {}, []

    def root(x: int) -> int:
        top = parent.setdefault(x, x)
        while top != parent[top]:
            parent[top] = top = parent[parent[top]]
        parent[x] = top
        return top

    for k in by_lcp:
        within, x, y = lcp[k], root(order[k]), root(order[k + 1])
        small, large = sets.pop(x, None) or Places(x), sets.pop(y, None) or Places(y)
        if small.size > large.size:
            small, large, x, y = large, small, y, x
        moved = list(small)
        for place, following in zip(moved, [*moved[1:], len(codes)], strict=True):
            before, after = large.add(place)
            # New neighbours come from different sets: none is between them that is still to be moved or came along.
            pairs = [(before, place)] if before >= 0 and root(before) != x else []
            if 0 <= after < following:
                pairs.append((place, after))
            for i, j in pairs:
                if j - i <= within and (i == 0 or codes[i - 1] != codes[j - 1]):
                    found.append((i, within, j - i))
        parent[x] = y
        sets[y] = large
    return found


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text, by start and period."""
    if len(words) < 6:
        return []
    windows, times = numbered(windows_of_three(words))
    often = np.flatnonzero(times >= 3)
    if len(often) < 4:
        return []
    cut = np.flatnonzero(np.diff(often) > 1) + 1
    lows, highs = np.concatenate([[0], cut]), np.concatenate([cut, [len(often)]])
    wide = highs - lows >= 4
    if not wide.any():
        return []
    codes, places, ends = [], [], len(windows)
    for k, (low, high) in enumerate(zip(lows[wide], highs[wide], strict=True)):
        stretch = often[low:high]
        codes += [windows[stretch], [ends + k]]  # an end of its own keeps every LCP inside its stretch
        places += [stretch, [stretch[-1] + 1]]
    places = np.concatenate(places)
    found = []
    for at, within, period in seeds(np.concatenate(codes)):
        length = within + period + 2
        if length >= max(6, 4 * period):
            found.append((int(places[at]), length, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words without the repeats of the runs, joined by one space."""
    if runs:
        depth = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            depth[start + period] += 1
            depth[start + length] -= 1
        words = [w for w, d in zip(words, np.cumsum(depth).tolist(), strict=False) if d == 0]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def _row(text: str | None) -> tuple:
    words = words_of(text)
    runs = runs_of(words)
    return len(words), runs, collapsed(words, runs)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row: all runs by start and period, and the text without repeats."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.field(0).type), *_RUNS_ARROW])
            rows = (_row_with(i, t) for low in range(0, batch.num_rows, 256)
                    for i, t in zip(batch.column(0).slice(low, 256).to_pylist(), batch.column(1).slice(low, 256).to_pylist(),
                                    strict=True))
            yield from in_batches(rows, schema, weight=lambda row: len(row[3]) + 24 * len(row[2]))

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, {_RUNS}")


def _row_with(doc_id, text: str | None) -> tuple:
    return (doc_id, *_row(text))


def without_repeats_of_runs(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``; texts that hold a run lose its repeats, the others stay as they are."""
    at = docs.columns.index("text")
    schema: StructType = docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(at).to_pylist():
                words = words_of(text)
                runs = runs_of(words)
                texts.append(collapsed(words, runs) if runs else text)
            columns = batch.columns
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(work, schema)


def with_planted_period(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where one id in ten has its words from some place on replaced by a repetition of the next few.

    With ``h`` the unsigned CRC-32 of the decimal id and ``g = h div 10``: if ``h`` ends in 0
    and there are ``n > 0`` words, word ``i >= a`` becomes word ``a + (i - a) % p``, where
    ``a = g % n`` and ``p = 1 + (n - a) div (3 + g % 8)``. Rows with a null id stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", SPACE), lambda w: w != "")

    def repeated(row: Column) -> Column:
        w, g = row["w"], row["g"]
        n = F.size(w).cast("long")

        def word(i: Column) -> Column:
            a = g % n
            p = F.lit(1).cast("long") + F.call_function("div", n - a, F.lit(3).cast("long") + g % 8)
            return F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))

        return F.when(n > 0, F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word)))

    g = F.call_function("div", h, F.lit(10).cast("long"))
    # A lambda's variable holds the words, so that they are split once per text.
    planted = F.transform(F.array(F.struct(words.alias("w"), g.alias("g"))), repeated)[0]
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(planted, "text")).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """Counts, the run of greatest exponent and digests per row, of texts with planted periods."""
    found = periodic_runs(with_planted_period(docs))

    def better(best: Column, run: Column) -> Column:
        # length / period by cross-multiplication; runs come by start and period, so a tie keeps the earlier one.
        return F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best)

    best = F.reduce("runs", F.get("runs", F.lit(0)), better)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))),
                                                   F.lit("\n")))
    top = found.select("*", best.alias("_best"))
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")),
        F.call_function("div", F.col("_best.length") * 1000, F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
