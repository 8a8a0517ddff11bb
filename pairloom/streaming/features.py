"""The features that need no other rows, over a stream of pairs. An extension: they are stateless, so any trigger gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pairs, text


def pair_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def overlap_features(stream: DataFrame) -> DataFrame:
    """id and the unweighted overlap family of (id, question1, question2)."""
    t = stream.select("id", text.tokens(F.col("question1")).alias("t1"), text.tokens(F.col("question2")).alias("t2"))
    f = pairs.overlap(F.col("t1"), F.col("t2"))
    return t.select("id", *(c.alias(n) for n, c in f.items()))
