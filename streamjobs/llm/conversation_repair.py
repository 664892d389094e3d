"""Repair of conversations by the cheapest edits that give alternating turns.

A conversation is its rows by turn (nulls first; ties by role, then text). Every row has at
most one fault, the first that holds: ``blank`` (no word in the text), ``duplicate`` (role and
text seen earlier in the conversation), ``truncated`` (the last character outside white space
is none of ``.!?``). Edits: Keep (0), Rerole to user or assistant (2), Delete (3, required for
blank and duplicate rows), Insert an empty user or assistant row anywhere (2); a truncated row
that stays adds 1. The initials of the repaired roles have the form ``(s?(ua)+)?``; among the
cheapest edits those win whose initials, in order, are least as text.

Search (``cheapest``): depth-first branch and bound over (row, role before it) with an
explicit stack. A suffix bound per node says what the rest costs at least; a branch whose cost
and bound exceed the incumbent's is cut. The incumbent is (cost, audit). A dominance table
per node keeps the best (cost, audit) that reached it, worse prefixes go: the rest does not
depend on how a node was reached, and of two audits with one node and cost neither begins the
other. Branches are tried in text order, so that the first full path that meets the bound of
the root is the result and ends the search.

Distribution: rows are range-partitioned by conversation and place, which cuts through a
conversation of any size, and streamed in order. Conversations that lie inside one partition
and fit a block are repaired at once. The few others (at a partition's edge, or longer) become
blocks of bounded size: their duplicates are found by a range sort of digests, every block is
searched from each role it may start with to each it may end with, and the ends are fitted by
the blocks' costs and ranks alone, without rows. A conversation's hash needs its text in
order, so one task streams the repaired blocks of a conversation; it holds one block at a time
and the audit, which is one value of the result.

Defined results: null roles and texts are one space, a null turn comes first and counts for no
gap, a null ``conv_id`` is a conversation of its own; a conversation without rows has zeros, an
empty audit and the hash of the empty text; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from streamjobs.llm.words import in_batches
from streamjobs.operators.ordered import previous_values
from streamjobs.session import written

BLOCK_ROWS, BLOCK_CHARS = 512, 1 << 20
#: The role before a row: none yet, system, user, assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
_STATES = (NONE, SYSTEM, USER, ASSISTANT)
_AFTER = {"u": USER, "a": ASSISTANT}
_NAME = {USER: "user", ASSISTANT: "assistant"}
#: What must be inserted after the last row, by the role before it.
_END = ("", "II", "I", "")
FAR = 1 << 40
_SPACE = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}

Row = tuple[str, bool, bool]  # initial of the role, must go, truncated


def _next(state: int) -> int:
    return ASSISTANT if state == USER else USER


def branches(row: Row, state: int) -> Iterator[tuple[str, int, int]]:
    """(edits, cost, role after) of everything that may be done at a row, in text order of the edits.

    One inserted row before a kept or reroled one is enough: two would lead back to the same role.
    """
    initial, must_go, truncated = row
    yield "D", 3, state
    if must_go:
        return
    step = _next(state)
    keep = _AFTER.get(initial)
    if keep is not None and keep == _next(step):
        yield "IK", 2 + truncated, keep
    yield "IR", 4 + truncated, _next(step)
    if keep == step:
        yield "K", int(truncated), keep
    elif initial == "s" and state == NONE:
        yield "K", int(truncated), SYSTEM
    yield "R", 2 + truncated, step


def suffix_bounds(rows: list[Row], end: tuple[int, ...]) -> list[list[int]]:
    """Least cost of the rows from each place on, by the role before it."""
    bounds = [list(end)]
    for row in reversed(rows):
        after = bounds[-1]
        bounds.append([min(cost + after[to] for _, cost, to in branches(row, state)) for state in _STATES])
    return bounds[::-1]


def cheapest(rows: list[Row], start: int, bounds: list[list[int]]) -> tuple[int, str] | None:
    """Cost and edits of the rows' best repair from a role on; None if no end can be reached.

    ``bounds`` are those of ``suffix_bounds``; its last entry says which ends are allowed, at what cost.
    """
    n, goal = len(rows), bounds[0][start]
    if goal >= FAR:
        return None
    incumbent: tuple[int, str] | None = None
    best: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        least = cost + bounds[at][state]
        if least > goal or (incumbent and (least, audit) > incumbent):
            continue
        known = best.get((at, state))
        if known and known <= (cost, audit):
            continue
        best[at, state] = cost, audit
        if at == n:
            incumbent = min(incumbent or (least, audit), (least, audit))
            if least == goal:
                break  # no path is cheaper, and those still on the stack come later as text
            continue
        for edits, more, to in reversed(list(branches(rows[at], state))):
            stack.append((at + 1, to, cost + more, audit + edits))
    return incumbent


def repaired_rows(rows: list[tuple[str, str]], audit: str, state: int = NONE) -> list[tuple[str, str]]:
    """Role and text of the repaired rows."""
    out, at = [], 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        if edit == "K":
            role, text = rows[at]
            state = SYSTEM if role[0] == "s" else _AFTER[role[0]]
        else:
            state = _next(state)
            role, text = _NAME[state], "" if edit == "I" else rows[at][1]
        at += edit != "I"
        out.append((role, text))
    return out


def fault_of(role: str, text: str, seen: bool) -> str:
    bare = text.rstrip(_SPACE)
    if not bare:
        return "blank"
    if seen:
        return "duplicate"
    return "" if bare[-1] in ".!?" else "truncated"


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))


def _judged(rows: list[tuple[str, str]], faults: list[str]) -> list[Row]:
    return [(role[:1], fault in ("blank", "duplicate"), fault == "truncated") for (role, _), fault in zip(rows, faults, strict=True)]


def _whole(rows: list[tuple], copies: list[int]) -> tuple:
    """Everything about a conversation whose rows (turn, role, text) are at hand."""
    turns = {t for (t, _, _), n in zip(rows, copies, strict=True) if n and t is not None}
    said = [(role, text) for (_, role, text), n in zip(rows, copies, strict=True) for _ in range(n)]
    seen, faults = set(), []
    for pair in said:
        faults.append(fault_of(*pair, pair in seen))
        seen.add(pair)
    judged = _judged(said, faults)
    bounds = suffix_bounds(judged, tuple(2 * len(e) for e in _END))
    cost, audit = cheapest(judged, NONE, bounds)
    state = _state_after(said, audit)
    audit += _END[state]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            illegal_pairs([role[:1] for role, _ in said]), cost, audit, repaired_rows(said, audit))


def _state_after(rows: list[tuple[str, str]], audit: str, state: int = NONE) -> int:
    at = 0
    for edit in audit:
        if edit == "K":
            initial = rows[at][0][0]
            state = SYSTEM if initial == "s" else _AFTER[initial]
        elif edit != "D":
            state = _next(state)
        at += edit != "I"
    return state


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_SAID = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_SAID_TYPE = "array<struct<role: string, text: string>>"


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(low, 256).columns), strict=True)


_FAULTS = ("blank", "duplicate", "truncated")


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


def _longs(*names: str) -> list[tuple[str, pa.DataType]]:
    return [(c, pa.int64()) for c in names]


def _ddl(*names: str) -> str:
    return ", ".join(f"{c} long" for c in names)


def first_pass(conversations: DataFrame, copies: Column | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Conversations repaired inside their partition, and the rows of all others, in one written table.

    ``copies`` says how often a row counts; 0 keeps no more of it than its conversation's id.
    Rows with ``place`` null are whole conversations, the others have (part, place) as their order.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), (F.lit(1) if copies is None else copies).cast("int").alias("copies"))
    # The first characters order as the texts do, and keep the bounds of the ranges small.
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32))
    ranged = ranged.sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = pa.schema([("conv_id", _arrow(conversations, "conv_id")), *_longs(*_COUNTS), ("audit", pa.string()), ("said", _SAID),
                        *_longs("part", "block", "place", "turn", "copies"), ("role", pa.string()), ("text", pa.string())])

    def weight(row: tuple) -> int:
        return 200 + (len(row[-1]) if row[8] is None else sum(len(text) for _, text in row[8]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(_closed_or_open(batches, block_rows), schema, weight=weight)

    return written(ranged.mapInArrow(work, f"conv_id {kind}, {_ddl(*_COUNTS)}, audit string, said {_SAID_TYPE}, "
                                           f"{_ddl('part', 'block', 'place', 'turn', 'copies')}, role string, text string"),
                   "conversations")


def _closed_or_open(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[tuple]:
    """Sorted rows as whole conversations, or row by row at the edges of the partition and beyond a block's size."""
    part = TaskContext.get().partitionId()
    block = place = chars = 0
    current, held, edge, long = object(), [], True, False

    def opened() -> Iterator[tuple]:
        nonlocal place, block
        for turn, role, text, copies in held:
            yield (current, *[None] * 8, part, block, place, turn, copies, role, text)
            place += 1
        block += 1

    def closed() -> tuple:
        return (current, *_whole([r[:3] for r in held], [r[3] for r in held]), *[None] * 7)

    for conv, *row in _streamed(batches):
        if conv != current:
            if held:
                yield from opened() if edge or long else [closed()]
                edge = False
            current, held, chars, long = conv, [], 0, False
        elif len(held) >= block_rows or chars + len(row[2]) > BLOCK_CHARS:
            yield from opened()
            held, chars, long = [], 0, True
        held.append(tuple(row))
        chars += len(row[2])
    yield from opened()


def _searched_blocks(rows: DataFrame) -> DataFrame:
    """Open rows as blocks, each with its counts and its cheapest repairs from every role to every role; written."""
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    said = (rows.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
                .select("conv_id", "part", "block", "place", "copy", "role", "text", digest.alias("digest")))
    seen = previous_values(said, ["conv_id", "digest"], ["part", "place", "copy"], "place", "earlier")
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ("part", "block", "place", "copy")
    ready = (seen.select("conv_id", *order, "role", "text", F.col("earlier").isNotNull().alias("seen"))
                 .repartition("part", "block").sortWithinPartitions(*order))
    ways = pa.list_(pa.struct([*_longs("start", "stop", "cost", "rank"), ("audit", pa.string())]))
    schema = pa.schema([("conv_id", _arrow(rows, "conv_id")), *_longs("part", "block", *_FAULTS, "illegal"),
                        ("opening", pa.string()), ("closing", pa.string()), ("ways", ways), ("said", _SAID)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = groupby(_streamed(batches), key=itemgetter(0, 1, 2))
        yield from in_batches((_searched(key, list(group)) for key, group in groups), schema, size=64)

    return written(ready.mapInArrow(work, f"conv_id {kind}, {_ddl('part', 'block', *_FAULTS, 'illegal')}, opening string, "
                                          "closing string, ways array<struct<start: long, stop: long, cost: long, rank: long, "
                                          f"audit: string>>, said {_SAID_TYPE}"), "conversation-blocks")


def _searched(key: tuple, rows: list[tuple]) -> tuple:
    said = [(role, text) for *_, role, text, _ in rows]
    faults = [fault_of(role, text, seen) for *_, role, text, seen in rows]
    judged, initials = _judged(said, faults), [role[:1] for role, _ in said]
    found = {}
    for stop in _STATES:
        bounds = suffix_bounds(judged, tuple(0 if state == stop else FAR for state in _STATES))
        for start in _STATES:
            best = cheapest(judged, start, bounds)
            if best:
                found[start, stop] = best
    ways = []
    for start in _STATES:
        ends = sorted((audit, stop, cost) for (begin, stop), (cost, audit) in found.items() if begin == start)
        ways += [(start, stop, cost, rank, audit) for rank, (audit, stop, cost) in enumerate(ends)]
    return (*key, *(faults.count(f) for f in _FAULTS), illegal_pairs(initials), initials[0], initials[-1], ways, said)


def fitted(blocks: list[dict[int, list[tuple[int, int, int]]]]) -> list[tuple[int, int, int]]:
    """(start, stop, cost) of every block of a conversation, from (stop, cost, rank) by start; cheapest, then least as text."""
    least = [[2 * len(e) for e in _END]]
    for ways in reversed(blocks):
        after = least[-1]
        least.append([min((cost + after[stop] for stop, cost, _ in ways.get(state, ())), default=FAR) for state in _STATES])
    least.reverse()
    state, out = NONE, []
    for k, ways in enumerate(blocks):
        rank, stop, cost = min((rank, stop, cost) for stop, cost, rank in ways[state] if cost + least[k + 1][stop] == least[k][state])
        out.append((state, stop, cost))
        state = stop
    return out


def _fitted_blocks(blocks: DataFrame) -> DataFrame:
    """``part, block, start, stop, extra, join``: the way taken in each block, what is inserted at the end, a pair that is illegal."""
    slim = (blocks.select("conv_id", "part", "block", "opening", "closing",
                          F.transform("ways", lambda w: F.array(w["start"], w["stop"], w["cost"], w["rank"])).alias("ways"))
                  .repartition("conv_id").sortWithinPartitions("conv_id", "part", "block"))
    schema = pa.schema([*_longs("part", "block", "start", "stop", "pair"), ("added", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(_fits(batches), schema)

    return slim.mapInArrow(work, f"{_ddl('part', 'block', 'start', 'stop', 'pair')}, added string")


def _fits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for _, group in groupby(_streamed(batches), key=itemgetter(0)):
        rows, by_start = [], []
        for _, part, block, opening, closing, ways in group:
            starts: dict = {}
            for start, *way in ways:
                starts.setdefault(start, []).append(tuple(way))
            by_start.append(starts)
            rows.append((part, block, opening, closing))
        closing = None
        for k, ((part, block, opening, after), (start, stop, _)) in enumerate(zip(rows, fitted(by_start), strict=True)):
            pair = closing is not None and closing + opening not in _LEGAL
            yield part, block, start, stop, int(pair), _END[stop] if k == len(rows) - 1 else ""
            closing = after


def repaired_blocks(conversations: DataFrame, copies: Column | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Repaired conversations: counts, cost, edits and the repaired rows (``said``).

    One row per conversation, with ``part`` and ``block`` null, but for conversations that do not
    lie in one partition and block: those have one row per block, in the order of (part, block),
    and one with ``block`` null and no repaired rows that carries their gaps.
    """
    stored = first_pass(conversations, copies, block_rows)
    columns = ["conv_id", "part", "block", *_COUNTS, "audit", "said"]
    whole, rows = stored.filter("place IS NULL").select(*columns), stored.filter("place IS NOT NULL")
    blocks = _searched_blocks(rows)
    taken = blocks.join(_fitted_blocks(blocks), ["part", "block"])
    way = F.filter("ways", lambda w: (w["start"] == F.col("start")) & (w["stop"] == F.col("stop")))[0]
    chosen = taken.select("*", way.alias("way"))
    parts = _rewritten(chosen.select(
        "conv_id", "part", "block", F.lit(0).cast("long").alias("gaps"), *_FAULTS, (F.col("illegal") + F.col("pair")).alias("illegal"),
        (F.col("way.cost") + 2 * F.length("added")).alias("cost"), F.concat("way.audit", "added").alias("audit"), "said", "start"))
    turns = F.when(F.col("copies") > 0, F.col("turn"))
    ids = rows.groupBy("conv_id").agg(
        F.coalesce(F.max(turns) - F.min(turns) + 1 - F.count_distinct(turns), F.lit(0).cast("long")).alias("gaps"))
    none = F.lit(0).cast("long")
    rest = ids.select("conv_id", F.lit(-1).cast("long").alias("part"), F.lit(None).cast("long").alias("block"), "gaps",
                      *[none.alias(c) for c in _COUNTS[1:]], F.lit("").alias("audit"), F.array().cast(_SAID_TYPE).alias("said"))
    return whole.unionByName(parts).unionByName(rest)


def _rewritten(blocks: DataFrame) -> DataFrame:
    """Blocks with their rows as the edits leave them."""
    schema = blocks.drop("start").schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, said, start = batch.columns
            rows = [[(r["role"], r["text"]) for r in block] for block in said.to_pylist()]
            audits = batch.column("audit").to_pylist()
            out = [repaired_rows(r, a, s) for r, a, s in zip(rows, audits, start.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, _SAID)], names=batch.schema.names[:-1])

    return blocks.mapInArrow(work, schema)


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, block, place, role, text``: the repaired rows, ordered inside a conversation by part, block, place."""
    return repaired_blocks(conversations).select("conv_id", "part", "block", F.posexplode("said").alias("place", "_row")).select(
        "conv_id", "part", "block", "place", "_row.role", "_row.text")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by the CRC-32 of ``conv_id:turn`` modulo 20, with ``copies``, the number of times a row is there.

    0 drops a row, 1 empties its text, 2 takes ``.!?`` out of it, 3 doubles it, 4 makes its role user.
    """
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    how = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = shown("text")
    return conversations.select(
        "conv_id", "turn", F.when(how == 4, F.lit("user")).otherwise(shown("role")).alias("role"),
        F.when(how == 1, F.lit("")).when(how == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(how == 0, F.lit(0)).when(how == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"))


def repair_report(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Counts, cost, edits and digest of the repair of every damaged conversation."""
    rows = damaged(conversations)
    blocks = written(repaired_blocks(rows, F.col("copies"), block_rows), "repaired-conversations")
    spoken = F.concat_ws("\n", F.transform("said", lambda r: F.concat(r["role"], F.lit(":"), r["text"])))
    columns = ["conv_id", *_COUNTS, "audit"]
    whole = blocks.filter("part IS NULL").select(*columns, F.sha2(spoken, 256).alias("repaired_sha256"))
    ordered = (blocks.filter("part IS NOT NULL").select(*columns, "part", "block", F.size("said").alias("n_said"), spoken.alias("spoken"))
                     .repartition("conv_id").sortWithinPartitions("conv_id", "part", "block"))
    schema = pa.schema([("conv_id", _arrow(conversations, "conv_id")), *_longs(*_COUNTS), ("audit", pa.string()),
                        ("repaired_sha256", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(_digests(batches), schema)

    return whole.unionByName(ordered.mapInArrow(work, whole.schema))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for conv, group in groupby(_streamed(batches), key=itemgetter(0)):
        sums, audits, digest, begun = [0] * len(_COUNTS), [], hashlib.sha256(), False
        for _, *counts, audit, _, _, n_said, spoken in group:
            sums = [a + b for a, b in zip(sums, counts, strict=True)]
            audits.append(audit)
            if n_said:
                digest.update(b"\n" if begun else b"")
                digest.update(spoken.encode("utf-8", "surrogatepass"))
                begun = True
        yield conv, *sums, "".join(audits), digest.hexdigest()


def _repair_sql() -> str:
    """The same in SQL: the best (cost, edits, text) of every conversation and role, row by row."""
    def way(state: str, cost: str, edits: str, *lines: str) -> str:
        said = "".join(f" || chr(10) || {line}" for line in lines)
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edits}', 't': {state}.t{said}}} END"

    def when(condition: str, text: str) -> str:
        return f"CASE WHEN {condition} THEN {text} END"

    def best(*ways: str) -> str:
        return f"list_sort([x FOR x IN [{', '.join(ways)}] IF x IS NOT NULL])[1]"

    own, new = "role || ':' || text", {USER: "'user:'", ASSISTANT: "'assistant:'"}

    def into(target: int) -> str:
        """All ways to end at user or assistant: directly from the roles before it, after an inserted row from the others."""
        letter, other = ("u", ASSISTANT) if target == USER else ("a", USER)
        before = {USER: (NONE, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}[target]
        ways, kept, named = [way(f"s{target}", "3", "D")], f"NOT gone AND initial = '{letter}'", f"{new[target]} || text"
        for s in _STATES:
            if s in before:
                ways += [when(kept, way(f"s{s}", "late", "K", own)), when("NOT gone", way(f"s{s}", "2 + late", "R", named))]
            else:
                ways += [when(kept, way(f"s{s}", "2 + late", "IK", new[other], own)),
                         when("NOT gone", way(f"s{s}", "4 + late", "IR", new[other], named))]
        return best(*ways)

    none = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR))"
    system = best(way("s1", "3", "D"), when("NOT gone AND initial = 's'", way("s0", "late", "K", own)))
    ends = best("s0", way("s1", "4", "II", new[USER], new[ASSISTANT]), way("s2", "2", "I", new[ASSISTANT]), "s3")
    return f"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(list_prepend(i, range(8)),
              lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
h AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(
            coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'),
            lambda x: CAST('0x' || x AS BIGINT))), lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8)), 4294967295) % 20 AS how
      FROM conversations, tab),
d AS (SELECT g, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
        CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE how WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
        row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS seen,
        regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut,
        lead(substr(role, 1, 1)) OVER (PARTITION BY g ORDER BY i) AS following FROM n),
r AS (SELECT g, i, role, text, initial, blank OR seen AS gone, CAST(NOT blank AND NOT seen AND cut AS BIGINT) AS late FROM f),
dp AS (SELECT g, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS s0, {none} AS s1, {none} AS s2, {none} AS s3
       FROM (SELECT DISTINCT g FROM h)
       UNION ALL
       SELECT dp.g, r.i, {way("s0", "3", "D")}, {system}, {into(USER)}, {into(ASSISTANT)}
       FROM dp JOIN r ON r.g = dp.g AND r.i = dp.i + 1),
done AS (SELECT g, {ends} AS e FROM dp WHERE i = (SELECT coalesce(max(r.i), 0) FROM r WHERE r.g = dp.g)),
c AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
        count(*) FILTER (NOT blank AND seen) AS duplicate, count(*) FILTER (NOT blank AND NOT seen AND cut) AS truncated,
        count(*) FILTER (following IS NOT NULL AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY g)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, e.c AS cost, e.a AS audit, sha256(substr(e.t, 2)) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM h) JOIN done USING (g) LEFT JOIN c USING (g)"""


REPAIR_SQL = _repair_sql()
