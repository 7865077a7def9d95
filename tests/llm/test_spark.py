"""Scratch tables of astrel.llm._spark."""

from pathlib import Path

from astrel.llm import _spark as S
from astrel.llm import ngram_join


def files(spark, path):
    return [f for f in Path(path.removeprefix("file://").removeprefix("file:")).rglob("*") if f.is_file()]


def test_written_keeps_types_nulls_and_parts(spark):
    """Without a file of checksums for each file, whose making starts a process in an executor."""
    rows = spark.sql("SELECT id % 3 AS part, IF(id = 4, null, id) AS n, array(id) AS list, named_struct('b', cast('x' AS binary)) AS s FROM range(9)")
    made = []
    with S.step(spark, made):
        table = S.written(rows, "part")
    assert sorted(table.select(*rows.columns).collect(), key=lambda r: r["list"]) == sorted(rows.collect(), key=lambda r: r["list"])
    names = [f.name for f in files(spark, made[0])]
    assert sum(n.endswith(".parquet") for n in names) >= 3 and not any(n.endswith(".crc") for n in names)
    S.delete(spark, made[0])
    assert not files(spark, made[0])


def test_few(spark):
    """A table of short rows has files by the input, however many partitions made it."""
    made = []
    with S.step(spark, made):
        S.written(S.few(spark.range(0, 600, 1, 60), 3 * S.FEW))
    assert sum(f.suffix == ".parquet" for f in files(spark, made[0])) == 3
    assert spark.read.parquet(made[0]).count() == 600
    assert S.few(spark.range(0, 600, 1, 60), 1).rdd.getNumPartitions() == 1


def test_join_writes_few_files(spark, corpus, monkeypatch):
    """Each file costs an executor up to three processes, so tables of short rows don't have one for each task."""
    written, counts = S.written, []

    def counted(df, *parts):
        made = []
        with S.step(spark, made):
            out = written(df, *parts)
        counts.append((tuple(df.columns), sum(f.suffix == ".parquet" for f in files(spark, made[0]))))
        return out

    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus] * 2, "doc_id long, text string").repartition(16)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    monkeypatch.setattr(S, "written", counted)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # as many tasks as a large table has
    try:
        assert ngram_join.ngram_join(docs).filter("n_similar > 0").count() > 100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    short = [n for c, n in counts if c in [("cid", "block"), ("b1", "b2", "side", "cid"), ("d", "t", "cid", "copies"), ("a", "b")] or "group_id" in c]
    assert len(short) == 6 and max(short) == 1, counts
