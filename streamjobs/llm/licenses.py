"""Licence scans: Dice coefficient over word bigrams between normalised units of text and licence templates.

Units of a document are its lines and, if it has several, the whole text. A unit of n
distinct bigrams and a template of m can only reach the threshold t if m lies between
n t / (2 - t) and n (2 - t) / t; other templates are never looked at. All of it is
DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dice coefficient from which a unit counts as the licence.
THRESHOLD = 0.8
#: Usual notices of public licences, fixed values.
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: Column) -> Column:
    """A-Z folded; every run of signs that are not a-z, 0-9 or line ends is one space."""
    return F.regexp_replace(F.translate(text.cast("string"), _UPPER, _LOWER), "[^a-z0-9\n]+", " ")


def words(line: Column) -> Column:
    return F.filter(F.split(line, "[ \n]+"), lambda w: w != "")


def bigrams(held: Column) -> Column:
    n = F.size(held)
    pairs = F.zip_with(F.slice(held, 1, n - 1), F.slice(held, 2, n - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def _values() -> str:
    return ", ".join(f"('{name}', '{text}')" for name, text in TEMPLATES)


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_values()} AS t(license, text)")


def license_report(docs: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The best licence of every unit that reaches ``threshold``, one row each.

    ``templates`` has ``license`` and ``text``. Returns ``doc_id, unit, license, dice, n_shared,
    n_bigrams, n_template``; unit 0 is the whole text of several lines, unit i its i-th line. Of
    equally good licences the first by name counts. Units and templates of fewer than two words,
    null and empty texts have no bigrams and match nothing; rows that repeat a doc_id or have none
    are scanned each for themselves. Empty tables give no rows.
    """
    least, most = threshold / (2 - threshold), (2 - threshold) / threshold
    of_templates = templates.select("license", bigrams(words(normal(F.col("text")))).alias("_grams")).withColumn(
        "n_template", F.size("_grams")).filter("n_template > 0")
    low, high = of_templates.agg(F.min("n_template"), F.max("n_template")).first()
    low, high = (low or 1) * least, (high or 0) * most

    def once(expression: Column, name: str) -> Column:
        """As a generator, so that no later filter or column computes the expression again."""
        return F.explode(F.array(expression)).alias(name)

    texts = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("_row"), F.col("text").cast("string"))
    texts = texts.filter("text is not null").select("doc_id", "_row", once(normal(F.col("text")), "_text"))
    lines = texts.select("doc_id", "_row", "_text", once(F.split("_text", "\n"), "_lines"))
    units = (lines.select("doc_id", "_row", F.posexplode(F.concat(
                      F.array(F.when(F.size("_lines") > 1, F.col("_text"))), F.col("_lines"))).alias("unit", "_line"))
                  .filter("_line is not null")
                  .select("doc_id", "_row", "unit", once(words(F.col("_line")), "_words"))
                  # n words have at most n - 1 distinct bigrams, k distinct words at least k - 1.
                  .filter((F.size("_words") - 1 >= low) & (F.size(F.array_distinct("_words")) - 1 <= high))
                  .select("doc_id", "_row", "unit", once(bigrams(F.col("_words")), "_grams"))
                  .withColumn("n_bigrams", F.size("_grams")).filter(F.col("n_bigrams").between(low, high)))
    grams = units.select("doc_id", "_row", "unit", "n_bigrams", F.explode("_grams").alias("_gram"))
    wanted = of_templates.select("license", "n_template", F.explode("_grams").alias("_gram"))
    in_bounds = F.col("n_template").between(F.col("n_bigrams") * least, F.col("n_bigrams") * most)
    shared = (grams.join(wanted, "_gram").filter(in_bounds)
                   .groupBy("_row", "doc_id", "unit", "license", "n_bigrams", "n_template")
                   .agg(F.count(F.lit(1)).alias("n_shared")))
    dice = F.col("n_shared") * 2.0 / (F.col("n_bigrams") + F.col("n_template"))
    best = (shared.withColumn("dice", dice).filter(F.col("dice") >= threshold)
                  .groupBy("_row", "doc_id", "unit")
                  .agg(F.min(F.struct((-F.col("dice")).alias("_far"), "license", "dice", "n_shared", "n_bigrams",
                                      "n_template")).alias("_best")))
    return best.select("doc_id", "unit", "_best.license", "_best.dice", "_best.n_shared",
                       F.col("_best.n_bigrams").cast("long").alias("n_bigrams"),
                       F.col("_best.n_template").cast("long").alias("n_template"))


def _sql() -> str:
    fold = "regexp_replace(translate({}, '" + _UPPER + "', '" + _LOWER + "'), '[^a-z0-9\\n]+', ' ', 'g')"
    split = "list_filter(regexp_split_to_array({}, '[ \\n]+'), lambda w: w <> '')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH t0(license, text) AS (VALUES {_values()}),
t1 AS (SELECT license, {split.format(fold.format('text'))} AS w FROM t0),
t AS (SELECT license, {pairs} AS g, len({pairs}) AS n_template FROM t1),
d AS (SELECT doc_id, string_split({fold.format('text')}, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
u0 AS (SELECT doc_id, 0 AS unit, array_to_string(lines, chr(10)) AS line FROM d WHERE len(lines) > 1
       UNION ALL SELECT doc_id, unnest(range(1, len(lines) + 1)), unnest(lines) FROM d),
u1 AS (SELECT doc_id, unit, {split.format('line')} AS w FROM u0),
u AS (SELECT doc_id, unit, {pairs} AS g, len({pairs}) AS n_bigrams FROM u1 WHERE len(w) > 1),
x AS (SELECT doc_id, unit, n_bigrams, unnest(g) AS gram FROM u),
y AS (SELECT license, n_template, unnest(g) AS gram FROM t),
s AS (SELECT doc_id, unit, license, n_bigrams, n_template, count(*) AS n_shared FROM x JOIN y USING (gram) GROUP BY ALL),
r AS (SELECT *, n_shared * 2.0::DOUBLE / (n_bigrams + n_template) AS dice FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, license) AS rn FROM r WHERE dice >= {THRESHOLD})
SELECT doc_id, CAST(unit AS INTEGER) AS unit, license, dice, n_shared, CAST(n_bigrams AS BIGINT) AS n_bigrams,
       CAST(n_template AS BIGINT) AS n_template FROM k WHERE rn = 1"""


LICENSE_SQL = _sql()
