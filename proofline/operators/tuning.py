"""Thresholds from reviewers' feedback."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import precision_recall

#: The label of a good edit, and what a decision is learned from.
GOOD = "chuẩn"
FEATURES = ("edit_ratio", "length_delta_ratio", "confidence")
LEAST_ROWS, LEAST_CLASSES = 10, 2


def join_labels(labels: DataFrame, review: DataFrame, model_mode: str) -> DataFrame:
    """Feedback rows: labelled edits (edit_id, user_label, user_suggested_text) with their records."""
    given = labels.where(F.length("user_label") > 0)
    return given.join(review.dropDuplicates(["edit_id"]), "edit_id").withColumn("model_mode", F.lit(model_mode))


def labelled(feedback: DataFrame) -> DataFrame:
    good = F.when(F.lower("user_label") == GOOD, 1).otherwise(0)
    return feedback.withColumn("label", good).na.fill(0.0, list(FEATURES))


def enough(feedback: DataFrame) -> bool:
    """Whether there is enough to learn from."""
    r = labelled(feedback).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("k")).first()
    return r["n"] >= LEAST_ROWS and r["k"] >= LEAST_CLASSES


def suggested(feedback: DataFrame, default_confidence: float = 0.85) -> DataFrame:
    """One row of thresholds: exact quantiles over good edits."""
    good = labelled(feedback).where("label = 1")
    conf = F.when(F.bool_or(F.col("model_mode") == "hybrid"), F.percentile("confidence", 0.05)).otherwise(F.lit(default_confidence))
    return good.agg(F.percentile("edit_ratio", 0.95).alias("edit_ratio"), F.percentile("length_delta_ratio", 0.95).alias("length_delta_ratio"), conf.alias("confidence"))


def fit_model(feedback: DataFrame):
    """A logistic regression with classes in balance: coefficients and predictions (label,
    prediction, probability). Raises if there is too little to learn from."""
    if not enough(feedback):
        raise ValueError(f"needs {LEAST_ROWS} labelled edits of {LEAST_CLASSES} classes at least")
    data = labelled(feedback)
    count = {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}
    n = sum(count.values())
    weight = F.lit(None).cast("double")
    for k, c in count.items():
        weight = F.when(F.col("label") == k, n / (len(count) * c)).otherwise(weight)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(data.withColumn("weight", weight))
    model = LogisticRegression(weightCol="weight", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, tol=1e-8, maxIter=200).fit(rows)
    out = model.transform(rows).withColumn("probability", F.get(vector_to_array("probability"), 1))
    return model, out.withColumn("prediction", F.col("prediction").cast("int"))


def classification_report(predicted: DataFrame) -> DataFrame:
    """label, support, tp, fp, fn, precision, recall, f1 of each class."""
    each = predicted.select("label", "prediction", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    own, said = F.col("label") == F.col("k"), F.col("prediction") == F.col("k")
    counted = each.groupBy("k").agg(F.count_if(own).alias("support"), F.count_if(own & said).alias("tp"), F.count_if(~own & said).alias("fp"), F.count_if(own & ~said).alias("fn"))
    return precision_recall(counted.withColumnRenamed("k", "label"))
