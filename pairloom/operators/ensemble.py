"""Ensembles and scores of prediction tables (model, id, p)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import materialize
from .frames import number_within


def weighted_mean(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, p): sum of weighted predictions over the sum of all weights; models without a weight are refused."""
    missing = predictions.select("model").distinct().join(weights, "model", "left_anti")
    if not missing.isEmpty():
        raise KeyError(f"no weight for {missing.first().model}")
    total = weights.agg(F.sum("weight")).first()[0]
    return predictions.join(weights, "model").groupBy("id").agg((F.sum(F.col("p") * F.col("weight")) / total).alias("p"))


def geometric_mean(predictions: DataFrame) -> DataFrame:
    """(id, p); 0 if any is 0 or less."""
    low = F.min("p") <= 0
    return predictions.groupBy("id").agg(F.when(low, 0.0).otherwise(F.exp(F.avg(F.log(F.when(F.col("p") > 0, F.col("p")))))).alias("p"))


def rank_average(predictions: DataFrame) -> DataFrame:
    """(id, p): ranks within each model (ties by id, from 0), averaged by id, ranked again and divided by n - 1."""
    by = predictions.withColumn("key", F.struct("p", "id"))
    ranks = number_within(by, "model", "key").groupBy("id").agg(F.avg(F.col("nth") - 1).alias("mean"))
    one = ranks.withColumn("all", F.lit(0)).withColumn("key", F.struct("mean", "id"))
    return number_within(one, "all", "key").select("id", F.coalesce(F.try_divide((F.col("nth") - 1).cast("double"), (F.col("of") - 1).cast("double")), F.lit(0.0)).alias("p"))


def symmetric_mean(forward: DataFrame, backward: DataFrame) -> DataFrame:
    return forward.select("id", "p").unionByName(backward.select("id", "p")).groupBy("id").agg(F.avg("p").alias("p"))


def correlations(predictions: DataFrame) -> DataFrame:
    """(model1, model2, corr) of each pair of models over their shared ids."""
    a, b = (predictions.select(F.col("model").alias(f"model{k}"), "id", F.col("p").alias(f"p{k}")) for k in "12")
    return a.join(b, "id").filter("model1 < model2").groupBy("model1", "model2").agg(F.corr("p1", "p2").alias("corr"))


def log_loss(label: Column, p: Column, eps: float = 1e-15) -> Column:
    p = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.avg(-(label * F.log(p) + (1 - label) * F.log1p(-p)))


def stretched(predictions: DataFrame) -> DataFrame:
    """(id, p) moved to the range 0 to 1; 0 if all are equal."""
    ends = predictions.agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    return predictions.crossJoin(F.broadcast(ends)).select("id", F.coalesce(F.try_divide(F.col("p") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)).alias("p"))


def expanding_correlation(predictions: DataFrame, first: str, second: str) -> DataFrame:
    """(id, corr) of two models over all ids up to each; the last row's is the correlation of all.

    Sums of ranges of ids come first, so the running frame of a row stays within its range.
    """
    a, b = (predictions.filter(F.col("model") == m).select("id", F.col("p").alias(c)) for m, c in ((first, "x"), (second, "y")))
    rows = materialize(a.join(b, "id").repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    mx, my = (m or 0.0 for m in rows.agg(F.avg("x"), F.avg("y")).first())  # sums of what lies around the means keep their digits
    rows = rows.withColumns({"x": F.col("x") - mx, "y": F.col("y") - my})
    parts = {"n": F.lit(1.0), "x": F.col("x"), "y": F.col("y"), "xx": F.col("x") * F.col("x"), "yy": F.col("y") * F.col("y"), "xy": F.col("x") * F.col("y")}
    rows = rows.select("id", "part", *(c.alias(f"v_{k}") for k, c in parts.items()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("part").agg(*(F.sum(f"v_{k}").alias(f"s_{k}") for k in parts))
    base = sums.select("part", *(F.coalesce(F.sum(f"s_{k}").over(before), F.lit(0.0)).alias(f"b_{k}") for k in parts))
    own = Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    t = rows.join(base, "part").select("id", *((F.sum(f"v_{k}").over(own) + F.col(f"b_{k}")).alias(k) for k in parts))
    up = F.col("n") * F.col("xy") - F.col("x") * F.col("y")
    down = F.sqrt((F.col("n") * F.col("xx") - F.col("x") * F.col("x")) * (F.col("n") * F.col("yy") - F.col("y") * F.col("y")))
    return t.select("id", F.when(F.col("n") > 1, F.try_divide(up, down)).alias("corr"))
