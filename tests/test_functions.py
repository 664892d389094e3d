import json

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamjobs.functions import parsing, randoms, scalar, text
from streamjobs.functions.envelope import schema_envelope
from streamjobs.functions.rules import config_violations
from streamjobs.plans import document_analytics as docs


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def values(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_missing_tags_and_null(spark):
    df = values(spark, "body Topic: t File: 3", "no tags", "", None, "b Topic: t")
    got = parsing.split_tags(df, [(" File: ", "file"), (" Topic: ", "topic")])
    assert [tuple(r) for r in got.collect()] == [("body", "3", "t"), ("no tags", None, None), ("", None, None),
                                                 (None, None, None), ("b", None, "t")]


def test_parse_delimited_is_lenient(spark):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("t", T.TimestampType()),
                           T.StructField("s", T.ShortType())])
    got = parsing.parse_delimited(values(spark, "1,2020-01-01 00:00:00,3", "x,y", "", None, "5,,99999"), schema)
    assert [r["a"] for r in got.collect()] == [1, None, None, None, 5]
    assert [r["s"] for r in got.collect()] == [3, None, None, None, None]


def test_parse_csv_ddl_and_json(spark):
    got = parsing.parse_csv_ddl(values(spark, "1,a", "x,b", "7"), "n INT, s STRING")
    assert rows(got) == [(1, "a"), (7, None), (None, "b")]
    got = parsing.extract_json(values(spark, '{"a":1,"b":true}', "{}", "not json"), ["a", "b", "z"])
    assert [tuple(r) for r in got.collect()] == [("1", "true", None), (None, None, None), (None, None, None)]


def test_text_is_parsed_once(spark):
    """A filter on several parsed fields must not copy the parsing."""
    schema = T.StructType([T.StructField(f"f{i}", T.IntegerType()) for i in range(8)])
    df = parsing.parse_delimited(values(spark, "1,2,3,4,5,6,7,8"), schema)
    for i in range(8):
        df = df.filter(F.col(f"f{i}") > 0)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 1
    assert df.count() == 1


def test_match_groups(spark):
    df = values(spark, "x a=1; b=2;\nrest", "a=1", "", None)
    got = parsing.unpack(df, parsing.match_groups(F.col("value"), r"a=(\d+); b=(\d+);", 2),
                         lambda p: [F.get(p, F.lit(1)).alias("a"), F.get(p, F.lit(2)).alias("b")],
                         when=parsing.matched(2))
    assert rows(got) == [("1", "2")]


def test_file_tag_and_fixed_width(spark):
    got = values(spark, "a File: 3", "plain", "File: 1File: 2").select(parsing.file_tag(F.col("value")))
    assert [r[0] for r in got.collect()] == ["3", "plain", "1"]
    got = parsing.decode_fixed_width(values(spark, "01000123aaaa", "9", None)).collect()
    assert tuple(got[0]) == ("01000123aaaa", "01", "000123", 12)
    assert tuple(got[1]) == ("9", "9", "", 1)


def test_null_handling(spark):
    df = spark.createDataFrame([("a", "None"), ("", "x"), (None, "y"), ("b", None)], "a string, b string")
    assert rows(parsing.drop_blank(df, ["a"]).select("a")) == [("a",), ("b",)]
    assert parsing.drop_text_none(df, "b").count() == 3


@pytest.mark.parametrize("given, want", [("0:01:02.500000", 62.5), ("0:01:02", 62.0), ("1:00:00", 3600.0),
                                         ("1 day, 0:00:01", 86401.0), ("-1 day, 23:59:59", -1.0), ("abc", None)])
def test_duration(spark, given, want):
    assert one(spark, scalar.duration_seconds(F.lit(given))) == want


def test_scalars(spark):
    assert one(spark, scalar.zero_pad(F.lit(7), 2)) == "07"
    assert one(spark, scalar.zero_pad(F.lit(1234567), 6)) == "1234567"
    assert one(spark, F.date_format(scalar.log_time(F.lit("2024-01-31 23:59:59,987")), "ss.SSS")) == "59.987"
    assert one(spark, scalar.log_time(F.lit("garbage"))) is None
    assert one(spark, scalar.option_code(F.lit("none"), ["None", "gzip"])) == 0
    assert one(spark, scalar.option_code(F.lit("zip"), ["None", "gzip"])) is None
    assert one(spark, scalar.option_name(F.lit(2), ["None", "gzip"])) == "gzip"
    assert one(spark, scalar.option_name(F.lit(9), ["None", "gzip"])) is None
    assert one(spark, scalar.after_last(F.lit("0:00:05.5"))) == "05.5"
    assert one(spark, scalar.topic_colour(F.lit(3), 10)) == 78
    assert [one(spark, scalar.round_half_even(F.lit(x))) for x in (0.125, 0.375, 2.5, None)] == [0.12, 0.38, 2.5, None]
    assert one(spark, scalar.rescale_knob(F.lit(0.001), F.lit(4))) == 1
    assert one(spark, scalar.rescale_knob(F.lit(0.0), F.lit(4), F.lit(2))) == 2
    assert one(spark, scalar.port_spec(F.lit("S3-P12"))[1]) == 12
    assert one(spark, scalar.seconds_between(F.timestamp_seconds(F.lit(1.25)), F.timestamp_seconds(F.lit(3.0)))) == 1.75


def test_posts(spark):
    got = text.clean_posts(values(spark, "RT @me: look http://a.b/c #funt_end", None, "SMARTt_endt_endx"))
    assert [r["post"] for r in got.collect()] == ["  look  fun", "SMA", "x"]


def test_sentiment(spark):
    lexicon = spark.createDataFrame([("good", 0.5, 0.5), ("bad", -1.0, 1.0)], "word string, polarity double, subjectivity double")
    df = spark.createDataFrame([(1, "Good, good and BAD"), (2, "nothing"), (3, ""), (4, None)], "id int, post string")
    got = {r["id"]: (r["polarity"], r["subjectivity"]) for r in text.score_sentiment(df, lexicon).collect()}
    assert got[1] == (0.0, pytest.approx(2 / 3)) and got[2] == (0.0, 0.0) and got[3] == (0.0, 0.0)
    joined = {r["id"]: (r["polarity"], r["subjectivity"]) for r in text.scores_by_join(df, lexicon, "id").collect()}
    assert joined[1] == (0.0, pytest.approx(2 / 3)) and joined[2] == joined[4] == (0.0, 0.0)
    with pytest.raises(ValueError):
        text.lexicon_buckets(lexicon, max_words=1)
    empty = text.score_sentiment(df, lexicon.limit(0))
    assert {r["polarity"] for r in empty.collect()} == {0.0}


def test_words_keep_empty_ones(spark):
    got = [r["word"] for r in text.words(values(spark, " a  b "), []).collect()]
    assert got == ["", "a", "", "b", ""]


def test_document_chain(spark):
    messages = values(spark, "a a b Topic: x File: 1", "a c Topic: x File: 2", "z Topic: y File: 1")
    terms = docs.document_terms(messages)
    assert ("x", "1", "a", 1, 2) in rows(terms)
    tagged = docs.tagged_terms(terms)
    assert "Topic: y File: 1  Word: z  Frequency: 1" in [r["value"] for r in tagged.collect()]
    repeated = tagged.union(tagged)
    assert rows(docs.mean_terms(repeated)) == [("x", 2.0), ("y", 1.0)]
    lines = [r["value"] for r in docs.mean_terms_text(docs.mean_terms(tagged)).collect()]
    assert "Topic: x Avg number of words for this topic: 2.0" in lines


def test_envelope(spark):
    df = spark.createDataFrame([(1, "a", None)], "n long, s string, d double")
    got = json.loads(schema_envelope(df).first()["value"])
    assert got["payload"] == {"n": 1, "s": "a"}
    assert {f["type"] for f in got["schema"]["fields"]} == {"string"}
    typed = json.loads(schema_envelope(df, typed=True).first()["value"])
    assert [f["type"] for f in typed["schema"]["fields"]] == ["int64", "string", "double"]


def test_rules(spark):
    df = spark.createDataFrame([(1, "gzip", 50.0, 10000, 500), (3, "zip", 101.0, 5999, 30000), (None, None, None, None, None)],
                               "acks int, compression string, message_rate double, session_timeout_ms long, replica_max_wait_ms long")
    got = [r["violations"] for r in config_violations(df).collect()]
    assert got == [[], ["acks", "compression", "message_rate", "session_timeout_ms", "replica_max_wait_ms"], []]


def test_random_values_depend_on_the_key_only(spark):
    df = spark.range(2000).select("id", randoms.hash_uniform(1, F.col("id")).alias("u"),
                                  randoms.hash_int(3, 9, 1, F.col("id")).alias("i"),
                                  randoms.hash_normal(10.0, 2.0, 1, F.col("id")).alias("n"),
                                  randoms.hash_poisson(120.0, 1, F.col("id")).alias("p"),
                                  randoms.hash_text(F.lit(5), "abc", 1, F.col("id")).alias("t"))
    first = rows(df)
    assert first == rows(df.repartition(3))
    u, i, n, p = ([r[k] for r in first] for k in (1, 2, 3, 4))
    assert abs(sum(u) / len(u) - 0.5) < 0.02 and set(i) == set(range(3, 10))
    assert abs(sum(n) / len(n) - 10) < 0.2
    mean = sum(p) / len(p)
    assert abs(mean - 120) < 1 and abs(sum((x - mean) ** 2 for x in p) / len(p) - 120) < 15
    assert all(len(r[5]) == 5 and set(r[5]) <= set("abc") for r in first)
    assert one(spark, randoms.hash_text(F.lit(0), "abc", 1)) == ""


def test_tagged_words_are_cut_as_by_split_and_hashed(spark):
    texts = ["", " File: ", "a File: b", " File: File: ", "a File: b File: c", "ä File: ö File: ü File: ", "aFile: ", None,
             "x File:  File: y", " File: File: File: z", "€ File: \U0001f600 File: "]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    for r in df.select(parsing._cut(F.col("value"), " File: ").alias("cut"), parsing._split(F.col("value"), " File: ").alias("parts")).collect():
        assert tuple(r["cut"]) == ((None, None) if r["parts"] is None else tuple([*r["parts"], None][:2]))
    lines = spark.createDataFrame([(f"Topic: t File: {f}  Word: {w}  Frequency: 1",) for f, w in ("1a", "1a", "1b", "2a")], "value string")
    mean = docs.mean_terms(lines)
    assert [tuple(r) for r in mean.collect()] == [("t", 1.5)]
    assert "SortAggregate" not in mean._jdf.queryExecution().executedPlan().toString()
