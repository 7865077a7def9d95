"""Relational operators of the analysis: partners, scopes, overrides, scores and reports.

Each takes and returns DataFrames.  Groups are reduced by aggregates with map-side
combining, so a key that holds a third of all rows is no special case.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from astrel.functions import scalars as X

#: Above this many entries the fuzzy pass is left out, as the analysis defines it; so its table may be broadcast.
FUZZY_LIMIT = 4000
BROADCAST_ROWS = 1_000_000
#: Buckets of a range count for each factor of e: a bucket is one percent wide.
RANGE_BUCKETS = 100


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; else AQE chooses the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def first_partner(df: DataFrame, key: Sequence[str], file: str, order: str) -> DataFrame:
    """df with partner_file and partner_order: the first row of its group in another file.

    Two minima in place of a self-join: a group's first row, and its first row in a
    file other than that one's.  Rows with a null key, and groups within one file, get nulls.
    """
    known = df.dropna(subset=list(key))
    first = known.groupBy(*key).agg(F.min(F.struct(F.col(order), F.col(file))).alias("a"))
    per_file = known.groupBy(*key, file).agg(F.min(F.struct(F.col(order), F.col(file))).alias("m"))
    other = per_file.join(first, list(key)).filter(F.col(file) != F.col("a")[file]).groupBy(*key).agg(F.first("a").alias("a"), F.min("m").alias("b"))
    pick = F.when(F.col(file) == F.col("a")[file], F.col("b")).otherwise(F.col("a"))
    return df.join(other, list(key), "left").withColumn("partner_file", pick[file]).withColumn("partner_order", pick[order]).drop("a", "b")


def duplicates_within(df: DataFrame, group: str, key: str) -> DataFrame:
    """Rows whose key occurs more than once in their group, with the count as copies."""
    counts = df.groupBy(group, key).agg(F.count("*").alias("copies")).filter("copies > 1")
    return df.join(counts, [group, key])


def near_duplicates(df: DataFrame, id_: str, file: str, size: str, vector: str, threshold: float = 0.92, ratio: float = 1.34, limit: int = FUZZY_LIMIT) -> DataFrame:
    """(id, partner): for each row the most similar one of another file, the first among equals.

    Similar means a cosine of at least threshold and sizes within ratio.  As in the
    analysis this pass is empty for more than limit rows; within the limit the
    vectors are a table of bounded size, held by each task and compared as matrices.
    """
    spark, kind = df.sparkSession, df.schema[id_].dataType.simpleString()
    rows = df.select(id_, file, size, vector).orderBy(id_).limit(limit + 1).collect()
    if not rows or len(rows) > limit:
        return spark.createDataFrame([], f"{id_} {kind}, partner {kind}")
    ids = [r[0] for r in rows]
    _, files = np.unique([str(r[1]) for r in rows], return_inverse=True)
    sizes = np.array([r[2] for r in rows], np.float64)
    table = np.array([r[3] for r in rows], np.float64)
    norms = np.sqrt((table**2).sum(1))
    at = {x: i for i, x in enumerate(ids)}

    def best(batches):
        for batch in batches:
            mine = np.array([at[x] for x in batch.column(0).to_pylist()], np.int64)
            got = []
            for block in np.array_split(mine, max(1, len(mine) // 256)):
                norm = norms[block][:, None] * norms[None, :]
                cos = np.divide(table[block] @ table.T, norm, out=np.zeros_like(norm), where=norm > 0).astype(np.float32)
                low, high = np.minimum(sizes[block][:, None], sizes[None, :]), np.maximum(sizes[block][:, None], sizes[None, :])
                ok = (files[block][:, None] != files[None, :]) & (high <= low * np.float32(ratio)) & (cos >= np.float32(threshold))
                cos = np.where(ok, cos, -1)
                got += [ids[j] if c >= 0 else None for j, c in zip(cos.argmax(1), cos.max(1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, batch.schema.field(0).type)], names=[id_, "partner"])

    return df.select(id_).mapInArrow(best, f"{id_} {kind}, partner {kind}").filter("partner is not null")


def count_within_ratio(df: DataFrame, id_: str, keys: Sequence[str], value: str, ratio: float) -> DataFrame:
    """(id, n): how many rows of other ids have the same keys and a value within ratio; ids without any are left out.

    Positive a and b are within ratio unless b > a * ratio or a > b * ratio.  So what a
    row meets are the values up to its limit, a * ratio, without the rows whose limit is
    below a: two ranks in one sorted run of values and limits, and no pairs are made.
    The run is cut into buckets, each led by a row with the totals of the lower ones,
    so that a large group is the work of many tasks.  Rows of one id don't count:
    a single row is taken off as it is, several are counted as a group of their own.
    """
    known = df.filter((F.col(value) > 0) & F.col(id_).isNotNull()).select(id_, *keys, F.col(value).cast("double").alias("v")).filter(" and ".join(f"`{k}` is not null" for k in keys) or "true")
    known = known.withColumn("again", F.count("*").over(Window.partitionBy(id_, *keys)) > 1)
    everyone = F.lit(None).cast(df.schema[id_].dataType)
    rows = known.withColumn("of", F.explode(F.when(F.col("again"), F.array(everyone, F.col(id_))).otherwise(F.array(everyone))))
    ends = F.array(F.struct(F.col("v").alias("x"), F.lit(False).alias("limit")), F.struct((F.col("v") * ratio).alias("x"), F.lit(True).alias("limit")))
    ends = rows.select(id_, *keys, "of", "again", F.inline(ends))
    bucket = F.floor(F.log(F.nanvl("x", F.lit(float("inf")))) * RANGE_BUCKETS)
    ends = ends.select("*", bucket.alias("bucket"), F.when(F.col("limit"), 0).otherwise(1).alias("values"), F.when(F.col("limit"), 1).otherwise(0).alias("limits"))
    lower = Window.partitionBy(*keys, "of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = ends.groupBy(*keys, "of", "bucket").agg(F.sum("values").alias("values"), F.sum("limits").alias("limits"))
    leads = totals.select(*keys, "of", "bucket", F.sum("values").over(lower).alias("values"), F.sum("limits").over(lower).alias("limits"))
    # Nulls sort first, so leads lead; a value precedes the limits that equal it, and equal rows share their sums.
    run = Window.partitionBy(*keys, "of", "bucket").orderBy("x", "limit").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = F.when(F.col("limit"), F.sum("values").over(run)).otherwise(-F.sum("limits").over(run) - F.when(F.col("again"), 0).otherwise(1))
    found = ends.unionByName(leads, allowMissingColumns=True).withColumn("n", met).filter("limit is not null")
    return found.groupBy(id_).agg(F.sum(F.when(F.col("of").isNull(), F.col("n")).otherwise(-F.col("n"))).alias("n")).filter("n > 0")


def strongest(df: DataFrame, entity: Sequence[str], rank: str) -> DataFrame:
    """For each entity the row with the smallest rank: an aggregate, not a window."""
    row = F.min(F.struct(F.col(rank), *[F.col(c) for c in df.columns if c not in (*entity, rank)])).alias("r")
    return df.groupBy(*entity).agg(row).select(*entity, *[F.col(f"r.{c}").alias(c) for c in df.columns if c not in entity])


def in_files(df: DataFrame, changes: DataFrame, file: str = "file") -> DataFrame:
    """Rows of files that changed."""
    return df.join(small(changes.select(F.col("file").alias(file)).distinct()), file, "left_semi")


def in_lines(df: DataFrame, changes: DataFrame, file: str = "file", line: str = "line") -> DataFrame:
    """Rows on changed lines; a change without a range covers its whole file."""
    c = small(changes.select(F.col("file").alias("f"), "start", "end"))
    return df.join(c, (df[file] == c["f"]) & (c["start"].isNull() | ((df[line] >= c["start"]) & (df[line] <= c["end"]))), "left_semi")


def override(findings: DataFrame, settings: DataFrame) -> DataFrame:
    """findings without rules that are off, and with the severities that settings(rule, setting) pin."""
    s = small(settings.select("rule", X.setting(F.col("setting")).alias("__set")).dropna())
    return findings.join(s, "rule", "left").filter(F.coalesce(F.col("__set"), F.lit("")) != "off").withColumn("severity", F.coalesce("__set", "severity")).drop("__set")


def score(findings: DataFrame, scored: Column | None = None) -> DataFrame:
    """One row: score, label, error_rules, warning_rules; distinct rules count, info doesn't."""
    rows = findings if scored is None else findings.filter(scored)
    got = rows.agg(
        F.count_distinct(F.when(F.col("severity") == "error", F.col("rule"))).alias("error_rules"),
        F.count_distinct(F.when(F.col("severity") == "warn", F.col("rule"))).alias("warning_rules"),
    )
    value = F.greatest(F.lit(0), F.round(F.lit(100.0) - F.lit(1.5) * F.col("error_rules") - F.lit(0.75) * F.col("warning_rules"))).cast("int")
    return got.select(value.alias("score"), X.score_label(value).alias("label"), "error_rules", "warning_rules")


def report_groups(findings: DataFrame, top: int = 3, locations: int = 5) -> tuple[DataFrame, DataFrame]:
    """(groups shown, locations shown): rules by severity, count and id; the first places of each."""
    groups = findings.groupBy("rule").agg(F.min(X.severity_rank(F.col("severity"))).alias("rank"), F.count("*").alias("n"))
    shown = groups.orderBy("rank", F.desc("n"), "rule").limit(top)
    nth = F.row_number().over(Window.partitionBy("rule").orderBy("file", "line"))
    places = findings.join(F.broadcast(shown.select("rule")), "rule", "left_semi").withColumn("nth", nth).filter(F.col("nth") <= locations)
    return shown, places


def sorted_findings(findings: DataFrame, *ties: str) -> DataFrame:
    """By severity, rule, file and line; ties are further columns that make the order total."""
    return findings.orderBy(X.severity_rank(F.col("severity")), "rule", "file", "line", *ties)


def any_error(findings: DataFrame) -> DataFrame:
    return findings.agg(F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).alias("any_error"))


def first_prefix(df: DataFrame, source: str, prefixes: Sequence[str]) -> DataFrame:
    """df with prefix: the first of the prefixes that its source begins with; rows without one go."""
    cases = [F.when(F.startswith(F.col(source), F.lit(p)), F.lit(p)) for p in prefixes]
    return df.withColumn("prefix", F.coalesce(*cases)).filter("prefix is not null") if cases else df.withColumn("prefix", F.lit(None).cast("string")).limit(0)


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """The row with the greatest version for each key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.col(version)).alias("r")).select(key, "r.*")
