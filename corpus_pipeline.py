"""A cleaning pipeline over documents: five stages, each one operator of astrel.llm.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before it
kept, and returns documents with their columns unchanged; its result is written as
Parquet and read again as the next one's docs.  Rows are dropped by joins with the
keys of what is dropped, so texts are moved only where that table is too large to
broadcast.  Null texts, repeated rows, missing ids and empty tables are handled as
the operators' docstrings say; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from astrel.llm import _spark as S
from astrel.llm import decontamination, exact_dedup, mixing, ngram_join, toxicity


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose (doc_id, xxhash64 of text) are in dropped(d, k)."""
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("d")) & (F.xxhash64(docs["text"]) == F.col("k"))
    return docs.join(S.small(S.written(dropped.distinct())), same, "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models don't predict to be toxic."""
    score = toxicity.scorer(*toxicity.train(docs, S.table(spark, sf_dir, "labels")))
    return docs.filter(score(F.col("text").cast("string")) < toxicity.THRESHOLD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal texts the row with the largest doc_id; of repeated rows one."""
    found = S.written(exact_dedup.exact_dedup(docs).filter(~F.col("kept")))
    sha = F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256)
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("d")) & (sha == F.col("s"))
    keys = [F.col("doc_id").alias("d"), F.col("text_sha256").alias("s")]
    wins = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    losers = S.written(found.filter(~wins).select(*keys).distinct())
    kept = docs.join(S.small(losers), same, "left_anti")
    repeated = S.written(found.filter(wins).select(*keys).distinct())
    if not repeated.limit(1).count():
        return kept
    many = kept.join(S.small(repeated), same, "left_semi")
    first = Window.partitionBy(F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))).orderBy("doc_id")
    many = many.select("*", F.row_number().over(first).alias("__nth")).filter("__nth = 1").drop("__nth")
    return kept.join(S.small(repeated), same, "left_anti").unionByName(many)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts the document with the smallest doc_id, by text_key where ids are equal or missing; missing ids come last."""
    found = ngram_join.ngram_join(docs).filter("group_id is not null").select("group_id", F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("d"), F.col("text_key").alias("k")).alias("doc"))
    found = S.written(S.few(found, S.partitions(docs)))
    first = found.groupBy("group_id").agg(F.min("doc").alias("first"))
    others = found.join(S.small(S.written(first)), "group_id").filter("doc <> first")
    return _without(docs, others.select("doc.d", "doc.k"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    found = decontamination.decontaminate(docs, S.table(spark, sf_dir, "benchmark")).filter("contaminated")
    return _without(docs, found.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target asks for, a row a repetition."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The first stage is a trained model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder and read again; tables that later stages don't read are deleted."""
    docs, made = S.table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        with S.step(spark, made):
            docs = S.written(stage(spark, docs, sf_dir))
    return docs
