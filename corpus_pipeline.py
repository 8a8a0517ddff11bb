"""From documents to packed training sequences, in five stages.

1. quality: documents that the quality classifier rejects go.
2. near_dedup: of each group of near duplicates (runs of five words, similarity 0.8 or more) the
   smallest doc_id stays.
3. substring_dedup: words in passages of 20 words or more that an earlier document has are cut;
   texts that lose nothing stay as they are, and n_chars follows the text.
4. mixing: sources are brought to their temperature weights, each used once at least; a row is there
   as often as the mix repeats it.
5. packing: the texts' tokens are packed into sequences; a row per piece.

Each stage reads what the one before it wrote. All but the last return the columns they got; columns
that a table lacks are not made up, apart from text, doc_id and (for mixing) source, which it must have.
Rows that share a doc_id are one document to the filters: they stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import common, mixing, near_dedup, packing, quality, substring_dedup


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    return docs.join(kept.select(F.col("doc_id").alias("__kept")).distinct(), F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = common.table(spark, sf_dir, "labels")
    return _only(docs, quality.classify(docs, quality.trusted_labels(labels), quality.bad_labels(labels)).filter("kept"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = near_dedup.near_groups(docs, width=5, num=80, den=100)
    return _only(docs, groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(docs, spacing=True, carry=True)
    changed = {"text": F.col("kept_text")} | ({"n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("carried.n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*((changed[c] if c in changed else F.col(f"carried.`{c}`")).alias(c) for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, ids=False, specials=True)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
