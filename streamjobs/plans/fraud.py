"""Training the payment classifier and scoring a stream of payments with it."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamjobs.functions.parsing import split_positions, to_doubles
from streamjobs.operators.ml import score, train_svm
from streamjobs.operators.sampling import balance, split_by_key

PAYMENT = T.StructType([
    T.StructField("step", T.IntegerType()), T.StructField("type", T.StringType()),
    T.StructField("amount", T.DoubleType()), T.StructField("nameOrig", T.StringType()),
    T.StructField("oldbalanceOrg", T.DoubleType()), T.StructField("newbalanceOrig", T.DoubleType()),
    T.StructField("nameDest", T.StringType()), T.StructField("oldbalanceDest", T.DoubleType()),
    T.StructField("newbalanceDest", T.DoubleType()), T.StructField("isFraud", T.IntegerType()),
    T.StructField("isFlaggedFraud", T.IntegerType()),
])
FEATURES = ["amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]
LABEL = "isFraud"
UNUSED = ["isFlaggedFraud", "step"]
SEED = 123


def clean(payments: DataFrame) -> DataFrame:
    return to_doubles(payments.drop(*UNUSED), [LABEL, *FEATURES])


def train(payments: DataFrame, negative_share: float = 0.01, train_share: float = 0.7,
          max_iter: int = 100) -> tuple[PipelineModel, DataFrame]:
    """The model, and the part of the balanced payments not used for it."""
    cleaned = clean(payments)
    balanced = balance(cleaned, LABEL, negative_share, SEED, cleaned.columns)
    fit, held = split_by_key(balanced, train_share, SEED + 1, cleaned.columns)
    fit = fit.persist()
    try:
        return train_svm(fit, FEATURES, LABEL, max_iter), held
    finally:
        fit.unpersist()


def parse_payments(messages: DataFrame) -> DataFrame:
    """CSV messages with all eleven fields; others are dropped, as are values that are no numbers."""
    rows = clean(split_positions(messages, PAYMENT.names).dropna())
    return rows.dropna(subset=FEATURES)


def predictions(messages: DataFrame, model: PipelineModel) -> DataFrame:
    return score(parse_payments(messages), model, LABEL)


def lines(scored: DataFrame) -> DataFrame:
    return scored.select(F.concat(F.lit("isFraud:  "), F.col(LABEL).cast("string"), F.lit("  "),
                                  F.lit("prediction:  "), F.col("prediction").cast("string")).alias("value"))
