"""Periodic runs, the rule ledger and the repair of conversations against plain restatements."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from check_oracle import duck, table_of
from helpers import EXTRA, awkward_rows, prose, table
from pyspark.sql import functions as F

from streamjobs.llm import conversation_repair, periodic_runs, quality_ledger

SF = "/root/testdata/sf0.001"
WS = " \t\n\x0b\x0c\r"


def split(text):
    return (text or "").encode().split()


def plain_runs(words):
    """Every period is tried at every place."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q):
                part = words[i:i + length]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_run_row(doc_id, text):
    words = planted(doc_id, split(text))
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_of_random_words():
    pick = random.Random(5)
    for _ in range(1500):
        words = [bytes([97 + pick.randrange(pick.choice([1, 2, 3, 5]))]) for _ in range(pick.randrange(60))]
        if words and pick.random() < 0.6:
            a, p = pick.randrange(len(words)), pick.randint(1, 12)
            words = [w if i < a else words[min(a + (i - a) % p, len(words) - 1)] for i, w in enumerate(words)]
        if pick.random() < 0.3:
            words = words + [b"x", b"y", b"z"] + words
        assert periodic_runs.runs_of(words) == plain_runs(words)


def test_places_are_ordered_across_blocks():
    pick = random.Random(1)
    order = pick.sample(range(20_000), 20_000)
    places = periodic_runs.Places(order[0])
    assert places.add(order[1]) == ((order[0], -1) if order[0] < order[1] else (-1, order[0]))
    for x in order[2:]:
        places.add(x)
    assert list(places) == list(range(20_000)) and places.size == 20_000 and len(places.blocks) > 4


def run_rows():
    rows = [r for r in awkward_rows() if len(r[1] or "") < 50_000]
    phrase = prose(11, 7)
    return rows + [(200 + i, t, "aa") for i, t in enumerate([
        " ".join([phrase] * 5), prose(12, 20) + " " + " ".join([phrase] * 4) + " " + phrase[:9], "x y " * 40 + "x y x " * 30,
        "a a a a a a b b b b b b", "a\x1ca " * 9, "p q r p q r p q r p q", "w " * 5, "w " * 6])] + [
        (i, prose(i, 60), "aa") for i in range(300, 360)]


def test_run_report(spark):
    rows = run_rows()
    got = sorted(map(tuple, periodic_runs.run_report(table(spark, rows)).collect()), key=repr)
    assert got == sorted((plain_run_row(r[0], r[1]) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 10


def test_runs_in_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = [plain_run_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text) < 6000]
    got = {r[0]: tuple(r) for r in periodic_runs.run_report(docs).collect()}
    assert len(got) == docs.count() and all(got[w[0]] == w for w in want) and len(want) > 150


def test_texts_lose_repeats_only(spark):
    rows = [(1, "one two  three", None), (2, "a b " * 4 + "c", None), (None, None, None)]
    out = periodic_runs.without_repeats_of_runs(table(spark, rows))
    assert out.columns[:3] == ["doc_id", "text", "lang"] and set(EXTRA) <= set(out.columns)
    assert {(r.doc_id, r.text) for r in out.collect()} == {(1, "one two  three"), (2, "a b c"), (None, None)}


def test_very_long_text_is_one_run(spark):
    row = periodic_runs.periodic_runs(table(spark, [(1, "same word " * 300_000, None)])).first()
    assert [tuple(r) for r in row.runs] == [(0, 600_000, 2)] and row.collapsed == "same word"


def plain_counts(text):
    words, lines = split(text), [x for x in (text or "").split("\n") if x.strip(WS)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    return (len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines), dup, len(covered),
            len(re.findall("[A-Z]", text or "")), len(re.findall("[a-z]", text or "")), (text or "").count("!"))


TEXTS = [None, "", " \n ", "a b", "a b c a b c", "x # y | z\nx # y | z\n\nx # y | z", "Ä ß 😀 <b> 100% $5 & co", "A! B! C! " * 30, "one\x0btwo\x1cthree",
         "the line\r\nthe line\nthe line", prose(3, 80), prose(4, 30) + "\n" + prose(4, 30), "q " * 60]


def test_counts():
    for text in TEXTS:
        assert quality_ledger.counts_of(text) == plain_counts(text)


def test_quality_report_matches_sql_on_awkward_rows(spark, tmp_path):
    import duckdb

    rows = awkward_rows() + [(400 + i, t, None) for i, t in enumerate(TEXTS)]
    docs = table(spark, rows)
    docs.select("doc_id", "text").coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got = quality_ledger.quality_report(docs)
    cursor = con.execute(quality_ledger.QUALITY_SQL)
    assert table_of(got.columns, map(tuple, got.collect())) == table_of([d[0] for d in cursor.description], cursor.fetchall())


def test_rules_keep_good_documents_and_drop_bad_ones(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_ledger.quality_report(docs).join(labels, "doc_id").filter("NOT base_failed OR quality = 0")
    share = {r.quality: r.kept for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] == 1.0 and share[0] == 0.0


def test_ablations(spark):
    docs = table(spark, awkward_rows() + [(400 + i, t, None) for i, t in enumerate(TEXTS)])
    rows = quality_ledger.ledger(quality_ledger.measured(docs)).cache()
    bits = [r.failed for r in rows.select("failed").collect()]
    for policy in quality_ledger.POLICIES:
        mask, known = quality_ledger.mask_of(policy), {r.name: r.mask for r in quality_ledger.RULES}
        for r in quality_ledger.ablations(rows, policy).collect():
            bit = known[r.rule]
            assert r.n_rows == len(bits) and r.n_kept == sum(b & mask == 0 for b in bits)
            assert r.n_failed == sum(b & bit != 0 for b in bits) and r.n_failed_alone == sum(b & mask == bit for b in bits)
            assert r.n_kept_without == sum(b & mask & ~bit == 0 for b in bits)
        assert quality_ledger.verdicts(rows, policy).filter("kept").count() == sum(b & mask == 0 for b in bits)
    kept = quality_ledger.without_low_quality(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(b & quality_ledger.mask_of(("clean", 2)) == 0 for b in bits)
    assert quality_ledger.ablations(rows.limit(0), ("base", 1)).count() == 0


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        h = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def plain_repair(rows):
    """Uniform-cost search over (row, role so far) by (cost, audit)."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(WS)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, at, said = heapq.heappop(heap)
        if i == len(rows) and at in ("", "a"):
            return faults, cost, audit, "\n".join(said)
        if (i, at) in done:
            continue
        done.add((i, at))
        for name in ("user", "assistant"):
            if (at, name[0]) in step:
                heapq.heappush(heap, (cost + 2, audit + "I", i, name[0], (*said, name + ":")))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, at, said))
        if faults[i] in ("", "truncated"):
            stays = cost + (faults[i] != "")
            if (at, role[:1]) in step:
                heapq.heappush(heap, (stays, audit + "K", i + 1, role[:1], (*said, f"{role}:{text}")))
            for name in ("user", "assistant"):
                if (at, name[0]) in step:
                    heapq.heappush(heap, (stays + 2, audit + "R", i + 1, name[0], (*said, f"{name}:{text}")))


def plain_report(rows):
    out, there = [], damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in there if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, cost, audit, said = plain_repair(mine)
        turns, initials = {r[0] for r in mine} - {None}, [r[1][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    return df.withColumns({k: F.lit("x") for k in ("part", "block", "place", "copies", "cost", "said", "start")})


def any_turns(conv, n, pick):
    roles = ["user", "assistant", "system", "tool", None, "", "usher"]
    return [(conv, pick.choice([None, i, i, i + 3]), pick.choice(roles[:2] if pick.random() < 0.7 else roles),
             pick.choice([f"t{pick.randrange(9)}.", f"t{pick.randrange(9)}", " \n", None, "Ok! ", "é?"])) for i in range(n)]


def awkward_conversations():
    pick = random.Random(8)
    rows = [r for conv in range(150) for r in any_turns(conv, pick.randrange(1, 12), pick)]
    rows += any_turns(None, 9, pick) + [(500, None, None, None), (501, 3, "user", "same."), (501, 3, "user", "same.")]
    rows += [(600, i, "user", "same.") for i in range(50)]
    rows += [(700, i, ("user", "assistant")[i % 2], prose(i, 8000) + ".") for i in range(4)]
    return rows + any_turns(900, 700, pick)


@pytest.mark.parametrize("block_rows", [conversation_repair.BLOCK_ROWS, 5])
def test_repair_report(spark, block_rows):
    rows = awkward_conversations()
    got = sorted(map(tuple, conversation_repair.repair_report(conversations(spark, rows), block_rows).collect()), key=repr)
    assert got == plain_report(rows)


def test_repair_of_given_conversations(spark):
    given = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, conversation_repair.repair_report(given).collect()), key=repr)
    assert got == plain_report(rows)


def test_no_conversations(spark):
    assert conversation_repair.repair_report(conversations(spark, [])).count() == 0


def test_repaired_turns_alternate(spark):
    rows = awkward_conversations()
    turns = conversation_repair.repaired_turns(conversations(spark, rows))
    of: dict = {}
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.part or 0, r.block or 0, r.place)):
        of[r.conv_id] = of.get(r.conv_id, "") + r.role[0]
    assert len(of) > 100 and all(re.fullmatch("s?(ua)+", initials) for initials in of.values())


def test_cheapest_over_blocks_is_cheapest_of_the_whole():
    pick = random.Random(3)
    for _ in range(300):
        rows = [(i, r or " ", t or " ") for i, (_, _, r, t) in enumerate(any_turns(0, pick.randrange(1, 9), pick))]
        faults, cost, audit, _ = plain_repair(rows)
        said = [(r, t) for _, r, t in rows]
        cuts = sorted({0, len(rows), *(pick.randrange(len(rows)) for _ in range(3))})
        ways = []
        for low, high in zip(cuts, cuts[1:]):
            judged = conversation_repair._judged(said[low:high], faults[low:high])
            starts: dict = {}
            for stop in range(4):
                bounds = conversation_repair.suffix_bounds(judged, tuple(0 if s == stop else conversation_repair.FAR for s in range(4)))
                for start in range(4):
                    best = conversation_repair.cheapest(judged, start, bounds)
                    if best:
                        starts.setdefault(start, []).append((best[1], stop, best[0]))
            ways.append({s: sorted(w) for s, w in starts.items()})
        fitted = conversation_repair.fitted([{s: [(stop, c, k) for k, (_, stop, c) in enumerate(w)] for s, w in b.items()} for b in ways])
        joined = "".join(next(a for a, stop, _ in b[s] if stop == t) for b, (s, t, _) in zip(ways, fitted))
        end = conversation_repair._END[fitted[-1][1]]
        assert joined + end == audit and sum(c for _, _, c in fitted) + 2 * len(end) == cost
