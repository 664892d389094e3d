"""Classifier and regressions on features of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from streamjobs.catalog.generated import uniform_sql
from streamjobs.catalog.registry import query, rounded, stream, table
from streamjobs.operators import ml
from streamjobs.plans import fraud
from streamjobs.session import fresh_path
from streamjobs.streaming.runs import collect_append


def payments(lineitem):
    """Line items as payments; a large share of returned items at a high discount is the fraud."""
    fraudulent = (F.col("l_discount") * 100 + F.col("l_tax") * 50 + F.col("l_quantity") / 10 > 13).cast("int")
    return lineitem.select(
        F.col("l_linenumber").alias("step"), F.col("l_returnflag").alias("type"), F.col("l_extendedprice").alias("amount"),
        F.col("l_orderkey").cast("string").alias("nameOrig"), (F.col("l_quantity") * 10).alias("oldbalanceOrg"),
        (F.col("l_discount") * 1000).alias("newbalanceOrig"), F.col("l_partkey").cast("string").alias("nameDest"),
        (F.col("l_tax") * 1000).alias("oldbalanceDest"), F.col("l_suppkey").cast("double").alias("newbalanceDest"),
        fraudulent.alias("isFraud"), F.lit(0).alias("isFlaggedFraud"))


def _messages(lineitem):
    return payments(lineitem).select(F.concat_ws(",", *fraud.PAYMENT.names).alias("value"))


_FRAUD = "CAST(l_discount * 100 + l_tax * 50 + l_quantity / 10 > 13 AS DOUBLE)"


def _saved_model(spark, sf):
    """The fitted model, and the same saved and loaded."""
    model, _ = fraud.train(payments(table(spark, sf, "lineitem")), negative_share=0.2)
    path = fresh_path(spark, "model")
    ml.save_model(model, path)
    return model, ml.load_model(path)


@query(f"""SELECT {_FRAUD} AS "isFraud", true AS same, count(*) AS n_rows FROM lineitem GROUP BY 1""")
def fraud_confusion(spark, sf):
    """Payments by label, scored as messages, and whether the saved model decides as the fitted one."""
    fitted, loaded = _saved_model(spark, sf)
    rows = fraud.parse_payments(_messages(table(spark, sf, "lineitem")))
    both = fitted.transform(rows).select(*rows.columns, F.col("prediction").alias("_fitted"))
    scored = loaded.transform(both).withColumn("same", F.col("prediction") == F.col("_fitted"))
    return scored.groupBy(fraud.LABEL, "same").agg(F.count(F.lit(1)).alias("n_rows"))


@query("""SELECT CAST(l_quantity > 25 AS DOUBLE) AS "isFraud", CAST(l_extendedprice > 30000 AS DOUBLE) AS prediction, count(*) AS n_rows
          FROM lineitem GROUP BY 1, 2""")
def confusion_counts(spark, sf):
    """Rows per label and prediction, for a prediction by a threshold."""
    decided = table(spark, sf, "lineitem").select((F.col("l_quantity") > 25).cast("double").alias("isFraud"),
                                                  (F.col("l_extendedprice") > 30000).cast("double").alias("prediction"))
    return ml.confusion(decided)


@query(f"""SELECT 'isFraud:  ' || CASE WHEN {_FRAUD} = 1 THEN '1.0' ELSE '0.0' END AS label, true AS same, count(*) AS n_rows
          FROM lineitem GROUP BY 1""")
def fraud_score_stream(spark, sf):
    """The lines of the scored stream, by label, and whether there are as many of each as the batch has."""
    _, model = _saved_model(spark, sf)

    def counted(lines, name):
        return lines.groupBy("value").agg(F.count(F.lit(1)).alias(name))

    streamed = collect_append(fraud.lines(fraud.predictions(_messages(stream(spark, sf, "lineitem")), model)))
    batch = fraud.lines(fraud.predictions(_messages(table(spark, sf, "lineitem")), model))
    both = counted(streamed, "n_rows").join(counted(batch, "_n"), "value", "full")
    label = F.substring_index("value", "  prediction", 1).alias("label")
    return both.groupBy(label).agg(F.every(F.col("n_rows").eqNullSafe(F.col("_n"))).alias("same"), F.sum("n_rows").alias("n_rows"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey,
             round((l_quantity - (SELECT min(l_quantity) FROM lineitem WHERE l_linenumber < 4))
                   / (SELECT max(l_quantity) - min(l_quantity) FROM lineitem WHERE l_linenumber < 4), 9) AS l_quantity,
             round((l_extendedprice - (SELECT min(l_extendedprice) FROM lineitem WHERE l_linenumber < 4))
                   / (SELECT max(l_extendedprice) - min(l_extendedprice) FROM lineitem WHERE l_linenumber < 4), 9) AS l_extendedprice
          FROM lineitem WHERE l_linenumber >= 4""")
def min_max_scaling(spark, sf):
    """Scale by the extremes of the first lines of the orders, applied to the other lines."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    _, scaled = ml.min_max_scale(rows.filter("l_linenumber < 4"), rows.filter("l_linenumber >= 4"),
                                 ["l_quantity", "l_extendedprice"])
    return rounded(scaled, 9, "l_quantity", "l_extendedprice")


def _runs(spark, sf):
    """One run per part: its items' mean settings as knobs and a result."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("run_index")).agg(
        F.avg("l_quantity").alias("k_quantity"), F.avg("l_discount").alias("k_discount"), F.avg("l_tax").alias("k_tax"),
        F.avg("l_extendedprice").alias("throughput"))


_RUN_SQL = """WITH r AS (SELECT l_partkey AS run_index, avg(l_quantity) AS k_quantity, avg(l_discount) AS k_discount,
                    avg(l_tax) AS k_tax, avg(l_extendedprice) AS throughput FROM lineitem GROUP BY 1)"""
_U = uniform_sql("1000", "run_index")


_CHARGE = "l_quantity * (1 - l_discount) * (1 + l_tax)"


@query(f"""WITH r AS (SELECT l_partkey AS run_index, avg({_CHARGE}) AS charge FROM lineitem GROUP BY 1),
           e AS (SELECT min(charge) AS lo, max(charge) AS hi FROM r WHERE {_U} < 0.8)
          SELECT 'charge' AS target, run_index AS run, round((charge - lo) / (hi - lo), 9) AS observed, true AS predicted,
            50 AS boosting_scores, 50 AS forest_scores, true AS better_chosen, true AS cv_r2_over_half, true AS test_r2_over_half
          FROM r, e WHERE {_U} >= 0.8""")
def state_regression(spark, sf):
    """The test runs of the model of the charge on the knobs; the idle metric is skipped.

    Each candidate is cross-validated 10 times in 5 folds; the better one is saved and loaded,
    and its R², over the folds and on the test runs, is over one half.
    """
    runs = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("run_index")).agg(
        F.avg("l_quantity").alias("k_quantity"), F.avg("l_discount").alias("k_discount"), F.avg("l_tax").alias("k_tax"),
        F.avg(F.expr(_CHARGE)).alias("charge"), (F.sum(F.lit(0))).alias("idle"))
    fitted = ml.fit_state_models(runs, "run_index", ["k_quantity", "k_discount", "k_tax"], ["charge", "idle"],
                                 save_to=fresh_path(spark, "state-models"))
    counted = fitted.scores.groupBy("target").pivot("model", ["boosting", "forest"]).agg(F.first("n_scores"))
    best = fitted.scores.groupBy("target").agg((F.max_by("chosen", "cv_r2")).alias("better_chosen"))
    r2 = ml.test_r2(fitted.tested).select("target", (F.col("test_r2") > 0.5).alias("test_r2_over_half"))
    return (fitted.tested.join(counted, "target").join(best, "target").join(r2, "target")
                  .select("target", "run", F.round("observed", 9).alias("observed"), (~F.isnan("predicted")).alias("predicted"),
                          F.col("boosting").cast("int").alias("boosting_scores"), F.col("forest").cast("int").alias("forest_scores"),
                          "better_chosen", (F.col("cv_r2") > 0.5).alias("cv_r2_over_half"), "test_r2_over_half"))


@query(f"""{_RUN_SQL} SELECT 'throughput' AS target, 'fixed' AS model,
             round(1 - sum((throughput - 1500 * k_quantity) ** 2) / (var_pop(throughput) * count(*)), 9) AS test_r2 FROM r""")
def state_regression_r2(spark, sf):
    """R² of a fixed linear prediction."""
    fixed = _runs(spark, sf).select(F.lit("throughput").alias("target"), F.lit("fixed").alias("model"),
                                    F.col("throughput").alias("observed"), (F.col("k_quantity") * 1500).alias("predicted"))
    return rounded(ml.test_r2(fixed), 9, "test_r2")
