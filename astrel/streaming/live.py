"""Live analysis: a stream of document versions, each linted whole; the newest version's findings stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from astrel.operators import relational as R
from astrel.plans.engine import Options, lint


def live(stream: DataFrame, sink: str, options: Options = Options()):
    """A started-to-be writer of stream(uri, version, text): each batch replaces the findings of its documents.

    A batch writes the versions it saw and their findings under its own id, so a
    batch that is run again after a failure overwrites itself.
    """

    def batch(df: DataFrame, number: int) -> None:
        newest = R.latest(df.select("uri", "version", "text"), "uri", "version").persist()
        newest.select("uri", "version").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/seen/batch={number}")
        found = lint(newest.select(F.col("uri").alias("file"), "text"), options)
        found.join(newest.select(F.col("uri").alias("file"), "version"), "file").write.mode("overwrite").parquet(f"{sink}/found/batch={number}")
        newest.unpersist()

    return stream.writeStream.foreachBatch(batch)


def current(spark: SparkSession, sink: str) -> DataFrame:
    """Findings of the newest version of each document."""
    seen = spark.read.parquet(f"{sink}/seen").drop("batch").groupBy(F.col("uri").alias("file")).agg(F.max("version").alias("version"))
    found = spark.read.parquet(f"{sink}/found").drop("batch").distinct()
    return found.join(seen, ["file", "version"])


def published(diagnostics: DataFrame) -> DataFrame:
    """What an editor is sent: ranges from zero, as wide as the snippet, and the help below the message."""
    start = F.col("column") - 1
    return diagnostics.select(
        F.col("file").alias("uri"), (F.col("line") - 1).alias("line"), start.alias("start"), F.greatest(F.octet_length("snippet"), start + 1).alias("end"),
        F.when(F.col("severity") == "error", 1).when(F.col("severity") == "warn", 2).otherwise(3).alias("severity"), F.col("rule").alias("code"), F.concat("message", F.lit("\n\n"), "help").alias("message"),
    )


def numbered(df: DataFrame) -> DataFrame:
    """diagnostics with emit_seq, their place in the report's order, for sinks that need a total order."""
    from astrel.functions import scalars as X

    w = Window.partitionBy("file").orderBy(X.severity_rank(F.col("severity")), "rule", "line", "column")
    return df.withColumn("emit_seq", F.row_number().over(w))
