"""Mixing sources to target weights by capped water-filling.

The targets of all sources rise in proportion to their weights; a source that
reaches its maximum number of epochs is clamped there and its excess is shared by
the others, again by weight, until no target is above its cap.  A source's target
is then met by whole repetitions of all its documents and one fractional
repetition: a seeded random prefix of its documents in the order of md5(doc_id).

The cut of the fractional repetition is found from sums over md5 prefixes, so
that only documents which share both prefixes with the cut are ever ordered:
a source that holds a third of all rows is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from astrel.llm import _spark as S

SEED = 17
MAX_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with position (0, 1, ...) by code point, null last; sorted in ranges, never in one task."""
    ranged = sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id())
    ranged = S.written(ranged)
    part = F.shiftright("at", 33)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row per partition
    first, total = {}, 0
    for r in sizes:
        first[r["part"]], total = total, total + r["n"]
    offset = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])[part] if first else F.lit(0)
    return ranged.withColumn("position", (offset + F.col("at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("at")


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of sources(source, weight long, source_size long, ...): adds target double.

    All sizes together are shared out by weight.  Each round fixes the level from
    two sums (exact integers) and clamps the sources above their cap; it ends when
    a round clamps none, after as many rounds as there are sources at most and
    about five in practice.  Only the sums come to the driver.
    """
    sources = sources.withColumn("cap", F.col("source_size") * max_epochs)
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    left = weight = None
    while True:
        if weight is None:
            free = F.lit(True)
        else:  # a source is free while weight * left <= cap * (sum of free weights)
            free = exact("weight") * F.lit(left).cast("decimal(38,0)") <= exact("cap") * F.lit(weight).cast("decimal(38,0)")
        row = sources.agg(
            F.sum(exact("source_size")).alias("all"), F.sum(F.when(~free, exact("cap"))).alias("clamped"), F.sum(F.when(free, exact("weight"))).alias("weight")
        ).first()
        total, clamped, now = int(row["all"] or 0), int(row["clamped"] or 0), int(row["weight"] or 0)
        if now == 0 or (total - clamped, now) == (left, weight):
            break
        left, weight = total - clamped, now
    if not weight:
        return sources.withColumn("target", F.col("cap").cast("double")).drop("cap")
    level = (exact("weight") * F.lit(left).cast("decimal(38,0)")).cast("double") / F.lit(float(weight))
    return sources.withColumn("target", F.least(level, F.col("cap").cast("double"))).drop("cap")


def _digest(seed: int):
    """What orders documents: by doc_id, or by the text where there is none, so that those spread too."""
    own = F.concat(F.col("doc_id").cast("string"), F.lit(f":{seed}"))
    text = F.concat(F.lit(f"null:{seed}:"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    return F.md5(F.when(F.col("doc_id").isNull(), text).otherwise(own).cast("binary"))


def _size():
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _plan(docs: DataFrame, max_epochs: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sized rows, what holds for each source, decisions for the rows around each source's cut).

    A source's row has its target, whole repetitions, words still needed, and the
    first and last md5 prefix of its cut: documents before it are taken once more,
    documents after it aren't, and those in it are decided one by one.
    """
    sized = S.written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size().alias("size"),
            _digest(seed).alias("md5"), F.xxhash64("text").alias("text_key"),
        )
    )
    sums = _numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = water_fill(sums.withColumn("weight", F.col("position") % 3 + 1), max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("whole", F.least(epochs, F.lit(max_epochs)).cast("long"))
    sources = S.written(sources.withColumn("need", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")))
    needs = S.small(sources.select(F.col("source").alias("s"), "need"))
    same = F.col("source").eqNullSafe(F.col("s"))

    # first level: words before each md5 prefix, at most 4,096 rows a source
    a, b = F.substring("md5", 1, 3), F.substring("md5", 4, 3)
    level = sized.groupBy("source", a.alias("a")).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    level = level.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).join(needs, same)
    cut = S.written(level.filter("before <= need and before + words >= need").select("s", "need", F.col("a").alias("cut_a"), F.col("before").alias("before_a")))
    # second level, inside the prefix that holds the cut; then document by document
    near = S.written(sized.join(S.small(cut), same & (a == F.col("cut_a"))).withColumn("b", b))
    level = near.groupBy("source", "cut_a", "before_a", "b").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source", "cut_a").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    level = level.withColumn("before_b", F.col("before_a") + F.coalesce(F.sum("words").over(before), F.lit(0)))
    level = level.select(F.col("source").alias("s2"), F.col("cut_a").alias("a2"), F.col("b").alias("b2"), "before_b")
    near = near.join(level, F.col("source").eqNullSafe(F.col("s2")) & (F.col("cut_a") == F.col("a2")) & (F.col("b") == F.col("b2")))
    order = Window.partitionBy("source", "cut_a", "b").orderBy("md5", "size").rowsBetween(Window.unboundedPreceding, -1)
    mid = F.col("before_b") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2
    decided = near.select("doc_id", "source", "size", "text_key", F.when((mid <= F.col("need")) & (F.col("need") > 0), 1).otherwise(0).alias("more"))
    edge = cut.groupBy(F.col("s").alias("s3")).agg(F.min("cut_a").alias("first_a"), F.max("cut_a").alias("last_a"))
    dims = sources.join(edge, F.col("source").eqNullSafe(F.col("s3")), "left").select(F.col("source").alias("s"), "source_size", "target", "whole", "first_a", "last_a")
    return sized, S.written(dims), S.written(decided)


def _split(rows: DataFrame, dims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(source, md5, ...) with their source's columns: (those decided by their md5 prefix, with more; those in a cut)."""
    rows = rows.join(S.small(dims), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("a", F.substring("md5", 1, 3))
    inside = F.coalesce((F.col("a") >= F.col("first_a")) & (F.col("a") <= F.col("last_a")), F.lit(False))
    return rows.filter(~inside).withColumn("more", F.when(F.col("a") < F.col("first_a"), 1).otherwise(0)), rows.filter(inside)


def mix(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix of docs(doc_id, text, source, ...): doc_id, size, source_size, target, repeats, taken.

    size is the number of words of the text (null or blank: 0); sources, ordered by
    code point with null last, weigh 1, 2, 3, 1, ...  repeats is how often the mix
    takes the document, taken its words times that.  A source's taken words differ
    from its target by at most half of one document.  Equal inputs and seeds give
    equal results in any order of rows.  Repeated rows count as often as they occur;
    a document without doc_id is ordered by its text; an empty table gives an empty mix.
    Columns other than these three are ignored.
    """
    sized, dims, decided = _plan(docs, max_epochs, seed)
    sure, _ = _split(sized, dims)
    cut = decided.join(S.small(dims), F.col("source").eqNullSafe(F.col("s")))
    keep = ["doc_id", "size", "source_size", "target", F.least(F.col("whole") + F.col("more"), F.lit(max_epochs)).cast("long").alias("repeats")]
    out = sure.select(*keep).unionByName(cut.select(*keep))
    return out.withColumn("taken", F.col("size") * F.col("repeats"))


def mixed(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of docs as often as mix() takes it.

    Adds repetition (1, 2, ...), source_size, target and taken (the words of this
    repetition); other columns of docs pass through and their texts are not shuffled.
    Rows with equal doc_id, source and text in one cut are decided alike.
    """
    _, dims, decided = _plan(docs, max_epochs, seed)
    names = docs.columns
    inner = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_key"), _digest(seed).alias("md5"), _size().alias("size"))
    sure, cut = _split(inner, dims)
    one = decided.groupBy(F.col("doc_id").alias("d"), F.col("source").alias("c"), F.col("text_key").alias("k")).agg(F.max("more").alias("more"))
    cut = cut.join(S.small(one), F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("c")) & (F.col("text_key") == F.col("k")))
    keep = ["row", "source_size", "target", F.col("size").alias("taken"), F.least(F.col("whole") + F.col("more"), F.lit(max_epochs)).cast("int").alias("repeats")]
    out = sure.select(*keep).unionByName(cut.select(*keep)).filter("repeats > 0")
    own = [c for c in ("repetition", "source_size", "target", "taken") if c not in names]
    out = out.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    return out.select("row.*", *own)


def oracle(max_epochs: int = MAX_EPOCHS, seed: int = SEED, documents: str = "documents") -> str:
    """The same in SQL: water levels from prefix sums over the sources in the order in which they fill."""
    return rf"""
WITH d AS (SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR) || ':{seed}', 'null:{seed}:' || md5(coalesce(text, '')))) AS h FROM {documents}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight,
    {max_epochs} * source_size AS cap FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS caps_before, sum(weight) OVER r AS weight_left,
    row_number() OVER (ORDER BY cap / CAST(weight AS DOUBLE), source) AS nth FROM w
    WINDOW o AS (ORDER BY cap / CAST(weight AS DOUBLE), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           r AS (ORDER BY cap / CAST(weight AS DOUBLE), source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
total AS (SELECT sum(source_size) AS words FROM s),
level AS (SELECT words - caps_before AS level_words, weight_left AS level_weight FROM f, total
    WHERE weight * (words - caps_before) <= cap * weight_left ORDER BY nth LIMIT 1),
t AS (SELECT f.source, source_size,
    least(CAST(weight * level_words AS DOUBLE) / CAST(level_weight AS DOUBLE), CAST(cap AS DOUBLE)) AS target
    FROM f, level),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), {max_epochs}) ELSE 0 END AS whole FROM t),
q AS (SELECT d.*, source_size, target, whole,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      + size / 2.0 <= target - CAST(whole * source_size AS DOUBLE) AS more
    FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  least(whole + CASE WHEN more AND target > whole * source_size THEN 1 ELSE 0 END, {max_epochs})::BIGINT AS repeats,
  (size * least(whole + CASE WHEN more AND target > whole * source_size THEN 1 ELSE 0 END, {max_epochs}))::BIGINT AS taken
FROM q
"""
