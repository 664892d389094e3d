"""Quality rules as a ledger of bits: every rule is evaluated once, policies and ablations are read from the bits.

Three steps, each over what the one before it stored:

* ``measured``: one pass over the texts counts words, characters, symbols, lines and windows.
* ``ledger``: every rule is a condition on those counts; the rules a document fails are the
  bits of one long, kept beside the counts. The ledger holds no texts and is written once.
* ``verdicts`` and ``ablations``: a policy is a named, versioned mask of rules. A document
  is kept where ``failed & mask = 0``; what a rule adds to a policy comes from counts per
  distinct value of ``failed & mask``, of which there are at most as many as sets of rules,
  so no ablation reads documents or evaluates a rule again.

A new policy therefore costs a scan of longs. Bits are never given to another rule: a changed
threshold is a new rule with the next bit.

Defined results: null and empty texts have no words and fail ``few_words``; shares of nothing
fail nothing; every row has its own ledger row, also where ids repeat or are null; empty tables
give empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamjobs.llm.word_numbers import numbered, windows_of_three
from streamjobs.llm.words import in_batches
from streamjobs.session import written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_exclaims")
_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


@dataclass(frozen=True)
class Rule:
    """A condition under which a document fails, in SQL over the counts, and its bit in the ledger."""

    bit: int
    name: str
    fails: str

    @property
    def mask(self) -> int:
        return 1 << self.bit


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 10 * n_words"),
    Rule(3, "short_words", "word_chars < 3 * n_words"),
    Rule(4, "long_words", "word_chars > 12 * n_words"),
    Rule(5, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(6, "capitals", "100 * n_upper > 50 * (n_upper + n_lower)"),
    Rule(7, "exclamations", "100 * n_exclaims > 30 * n_words"),
)

#: Names and versions of the rules in force together.
POLICIES = {
    ("base", 1): ("few_words", "repeated_windows"),
    ("clean", 1): ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    ("clean", 2): tuple(rule.name for rule in RULES),
}


def counts_of(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()

    def among(chars: bytes) -> int:
        return len(raw) - len(raw.translate(None, chars))

    lines = [line for line in raw.split(b"\n") if line.strip()]
    keys = windows_of_three(words)
    covered = 0
    if len(keys):
        again = numbered(keys)[1] > 1
        if again.any():
            inside = np.zeros(len(words), bool)
            for shift in range(3):
                inside[shift:shift + len(again)] |= again
            covered = int(inside.sum())
    return (len(words), len(text) - among(_SPACE), among(_SYMBOLS), len(lines), len(lines) - len(set(lines)), covered,
            among(_UPPER), among(_LOWER), raw.count(b"!"))


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.field(0).type), *((c, pa.int64()) for c in COUNTS)])
            rows = ((doc_id, *counts_of(text)) for low in range(0, batch.num_rows, 256)
                    for doc_id, text in zip(*(batch.column(c).slice(low, 256).to_pylist() for c in (0, 1)), strict=True))
            yield from in_batches(rows, schema)

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def ledger(counts: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The counts with ``failed``, a long with the bit of every rule that a row fails."""
    failed = F.lit(0).cast("long")
    for rule in rules:
        failed = failed.bitwiseOR(F.when(F.expr(rule.fails), F.lit(rule.mask)).otherwise(F.lit(0)).cast("long"))
    return counts.withColumn("failed", failed)


def mask_of(policy: tuple[str, int], rules: Sequence[Rule] = RULES, policies=None) -> int:
    """The bits of a policy's rules."""
    names = (policies or POLICIES)[policy]
    known = {rule.name: rule.mask for rule in rules}
    return sum(known[name] for name in set(names))


def passes(mask: int) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask).cast("long")) == 0


def verdicts(rows: DataFrame, policy: tuple[str, int]) -> DataFrame:
    """The ledger's rows with ``kept``: none of the policy's rules fails."""
    return rows.withColumn("kept", passes(mask_of(policy)))


def ablations(rows: DataFrame, policy: tuple[str, int], rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per rule of a policy: rows that fail it, that fail it alone, and that would be kept without it.

    One aggregate per distinct set of failed rules, then bit tests on those sets.
    """
    mask = mask_of(policy, rules)
    sets = (rows.select(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("bits"))
                .groupBy("bits").agg(F.count(F.lit(1)).alias("n")))
    of_policy = F.array(*[F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.mask).cast("long").alias("bit"))
                          for rule in rules if rule.mask & mask])
    rule = sets.select("bits", "n", F.explode(of_policy).alias("r")).select("bits", "n", "r.rule", "r.bit")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0).cast("long"))

    bits, bit = F.col("bits"), F.col("bit")
    return rule.groupBy("rule").agg(
        F.sum("n").alias("n_rows"), total(bits == 0).alias("n_kept"), total(bits.bitwiseAND(bit) != 0).alias("n_failed"),
        total(bits == bit).alias("n_failed_alone"), total((bits == 0) | (bits == bit)).alias("n_kept_without"))


def without_low_quality(docs: DataFrame, policy: tuple[str, int] = ("clean", 2)) -> DataFrame:
    """The rows of ``docs`` that a policy keeps, judged row by row in the scan's task."""
    bits = F.pandas_udf(_bits, "long")
    return docs.filter(bits("text").bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0)


def _bits(texts):
    import pandas as pd

    rows = pd.DataFrame([counts_of(t if isinstance(t, str) else None) for t in texts], columns=COUNTS, dtype="int64")
    failed = np.zeros(len(rows), np.int64)
    for rule in RULES:
        failed |= rows.eval(rule.fails).to_numpy(bool).astype(np.int64) << rule.bit if len(rows) else 0
    return pd.Series(failed)


def quality_report(docs: DataFrame) -> DataFrame:
    """Per row the counts of the base rules, whether one of those fails, and the verdict of policy clean, version 2."""
    stored = written(ledger(measured(docs)), "quality-ledger")
    judged = verdicts(stored, ("clean", 2))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         (~passes(mask_of(("base", 1)))).alias("base_failed"), "kept")


#: The same counts and rules in SQL.
QUALITY_SQL = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
  w AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM
          (SELECT rid, [x FOR x IN string_split_regex(text, '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM d)),
  g AS (SELECT rid, pos, word, lead(word, 1) OVER p AS b, lead(word, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY rid ORDER BY pos)),
  again AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, word, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1),
  covered AS (SELECT rid, count(DISTINCT pos + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
  counted AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY rid),
  lines AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
            FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
  m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
          CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
          coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
          length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower,
          length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaims
        FROM d LEFT JOIN counted USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words OR word_chars < 3 * n_words
       OR word_chars > 12 * n_words OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_upper > 50 * (n_upper + n_lower)
       OR 100 * n_exclaims > 30 * n_words) AS kept
FROM m"""
