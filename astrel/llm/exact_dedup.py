"""Exact dedup by a Golomb-coded fingerprint exchange.

1. Each scan task hashes its texts and assigns every fingerprint to the owner of
   its hash range.  Per owner it sorts the fingerprints, Golomb-Rice codes the
   gaps and sends one message.
2. Owners decode, mark fingerprints that any two texts share and answer each
   message with a bitmap in the order of its fingerprints.
3. Only texts whose bit is set are shuffled, grouped by their bytes; the rest are
   known to be unique without having moved.

Nothing is collected: the messages are about 20 bits a document, and a group of
copies of any size is reduced on the map side before its text is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrel.llm import _spark as S

#: Bits of a fingerprint within its owner's range: few enough to code well, enough to keep false suspects rare.
BITS = 40
#: Fingerprints held by a scan task before it sends its messages.
HELD = 1 << 20
#: Owners at most: each takes some five bytes a document, so a few million documents apiece are little, and more owners make messages short.
OWNERS = 4096


def rice_encode(sorted_values: np.ndarray, bits: int = BITS) -> tuple[int, bytes]:
    """(Rice parameter, bytes) of ascending integers below 2**bits; repeats give gaps of zero."""
    gaps = np.diff(sorted_values.astype(np.int64), prepend=0)
    mean = (1 << bits) // max(len(gaps), 1)
    k = max(int(mean).bit_length() - 1, 0)
    high, low = gaps >> k, gaps & ((1 << k) - 1)
    # unary part: high zeros and a one for each gap; then the low parts, k bits each
    ones = np.cumsum(high + 1) - 1
    unary = np.zeros(int(ones[-1]) + 1 if len(ones) else 0, np.uint8)
    unary[ones] = 1
    rest = ((low[:, None] >> np.arange(k - 1, -1, -1)) & 1).astype(np.uint8).ravel() if k else np.zeros(0, np.uint8)
    return k, np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def rice_decode(k: int, count: int, coded: bytes) -> np.ndarray:
    """Inverse of rice_encode."""
    if not count:
        return np.zeros(0, np.int64)
    low_bytes = (count * k + 7) // 8
    head = np.frombuffer(coded[: len(coded) - low_bytes], np.uint8)
    ones = np.flatnonzero(np.unpackbits(head))[:count]
    high = np.diff(ones, prepend=-1) - 1
    low = np.zeros(count, np.int64)
    if k:
        rest = np.unpackbits(np.frombuffer(coded[len(coded) - low_bytes :], np.uint8))[: count * k].reshape(count, k)
        for i in range(k):
            low = (low << 1) | rest[:, i]
    return np.cumsum((high.astype(np.int64) << k) | low)


_ROWS = "kind string, owner int, chunk long, k int, count int, coded binary, doc_id long, rank int, sha binary"


def _send(owners: int):
    """Scan side: rows of kind doc and messages of kind msg."""

    def flush(held: list[pa.RecordBatch], chunk: int):
        rows = pa.Table.from_batches(held).combine_chunks()
        sha = rows["sha"].combine_chunks() if isinstance(rows["sha"], pa.ChunkedArray) else rows["sha"]
        raw = np.frombuffer(b"".join(sha.to_pylist()), ">u8").reshape(-1, 4)[:, 0].astype(np.uint64)
        owner = (((raw >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)).astype(np.int64)
        value = (raw * np.uint64(owners)) >> np.uint64(64 - BITS)  # the position inside the owner's range
        order = np.lexsort((value, owner))
        cuts = np.searchsorted(owner[order], np.arange(owners + 1))
        rank = np.empty(len(raw), np.int32)
        rank[order] = np.arange(len(raw)) - cuts[owner[order]]
        n = len(raw)

        def batch(**cols):
            return pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(len(cols["kind"]), f.type)) for f in _SCHEMA], schema=_SCHEMA)

        yield batch(kind=pa.array(["doc"] * n), owner=pa.array(owner, pa.int32()), chunk=pa.array(np.full(n, chunk)), doc_id=rows["doc_id"].combine_chunks(), rank=pa.array(rank), sha=sha)
        sent = [o for o in range(owners) if cuts[o] < cuts[o + 1]]
        coded = [rice_encode(value[order[cuts[o] : cuts[o + 1]]]) for o in sent]
        yield batch(
            kind=pa.array(["msg"] * len(sent)), owner=pa.array(sent, pa.int32()), chunk=pa.array(np.full(len(sent), chunk)),
            k=pa.array([k for k, _ in coded], pa.int32()), count=pa.array([int(cuts[o + 1] - cuts[o]) for o in sent], pa.int32()), coded=pa.array([c for _, c in coded], pa.binary()),
        )

    def over(batches):
        from pyspark import TaskContext

        chunk, held, n = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= HELD:
                yield from flush(held, chunk)
                chunk, held, n = chunk + 1, [], 0
        if n:
            yield from flush(held, chunk)

    return over


_SCHEMA = pa.schema([("kind", pa.string()), ("owner", pa.int32()), ("chunk", pa.int64()), ("k", pa.int32()), ("count", pa.int32()), ("coded", pa.binary()), ("doc_id", pa.int64()), ("rank", pa.int32()), ("sha", pa.binary())])


def _answer(batches):
    """Owner side: a bitmap for each message, as 64-bit words, bit i for the i-th fingerprint."""
    got = [(o, c, k, n, x) for b in batches for o, c, k, n, x in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)]
    for o in sorted({g[0] for g in got}):
        own = [g for g in got if g[0] == o]
        values = [rice_decode(k, n, x) for _, _, k, n, x in own]
        distinct, times = np.unique(np.concatenate(values), return_counts=True)
        shared = distinct[times > 1]
        out = []
        for v in values:
            at = np.minimum(np.searchsorted(shared, v), max(len(shared) - 1, 0))
            bits = shared[at] == v if len(shared) else np.zeros(len(v), bool)
            words = np.packbits(np.pad(bits, (0, -len(bits) % 64)), bitorder="little").view("<i8")
            out.append(words)
        keep = [i for i, w in enumerate(out) if w.any()]
        if keep:
            yield pa.RecordBatch.from_arrays(
                [pa.array([o] * len(keep), pa.int32()), pa.array([own[i][1] for i in keep], pa.int64()), pa.array([out[i].tolist() for i in keep], pa.list_(pa.int64()))], names=["owner", "chunk", "bits"]
            )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Groups of byte-identical texts in docs(doc_id, text, ...); other columns are ignored.

    Returns a row for each row of docs: doc_id, keep_id (largest doc_id of the
    group), group_size, kept, text_sha256.  A null text equals the empty text.  A
    null doc_id never wins against a number; in a group of nulls only, keep_id is
    null and one row is kept.  Of repeated rows with the winning doc_id, one is
    kept.  An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    owners = min(S.partitions(texts), OWNERS)
    sent = S.written(texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha")).mapInArrow(_send(owners), _ROWS), "kind")
    messages = sent.filter("kind = 'msg'").select("owner", "chunk", "k", "count", "coded")
    bits = messages.repartitionById(owners, F.col("owner")).mapInArrow(_answer, "owner int, chunk long, bits array<long>")
    rows = sent.filter("kind = 'doc'").select("owner", "chunk", "rank", "doc_id", "sha")
    hit = F.expr("shiftright(element_at(bits, cast(rank div 64 as int) + 1), rank % 64) & 1") == 1
    suspects = S.written(rows.join(S.small(S.written(bits), 200_000), ["owner", "chunk"]).filter(hit).select("sha").distinct())
    moved = texts.withColumn("sha", F.unhex(F.sha2("text", 256))).join(S.small(suspects), "sha", "left_semi")
    groups = moved.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = S.written(groups.filter("group_size > 1").select(F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size"))
    # of the rows with the winning doc_id the first is kept; found by an aggregate, since they may be many
    place = F.struct("chunk", "owner", "rank")
    winners = rows.join(S.small(groups.select("sha", "keep_id")), "sha").filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    groups = S.written(groups.join(winners.groupBy("sha").agg(F.min(place).alias("first")), "sha"))
    alone = F.col("group_size").isNull()
    return rows.join(S.small(groups), "sha", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (place == F.col("first"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text),
r AS (SELECT t.doc_id, g.keep_id, g.group_size, t.text,
        row_number() OVER (PARTITION BY t.text, t.doc_id) AS nth
      FROM t JOIN g ON t.text = g.text)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size,
  (doc_id IS NOT DISTINCT FROM keep_id AND nth = 1) AS kept, sha256(text) AS text_sha256
FROM r
"""
