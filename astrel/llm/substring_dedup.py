"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of half a window.
Any repeat of a whole window contains one complete block of the earlier document,
so probing the blocks with every rolling window of block length finds an anchor
in each repeat.  An anchor is extended to the windows of full length around it;
those that start in an earlier document too are maximal exact repeats, joined
where they overlap.

Blocks and probes meet at the owners of their hash ranges in packed form.  An owner
answers with positions, never with pairs of documents.  What a task can decide
among its own documents it doesn't send: of the documents that share a passage,
only those that may be the earliest go to the owner, so that a passage that a third
of all documents share brings it a few messages from each task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrel.llm import _kernel as K
from astrel.llm import _packed as P
from astrel.llm import _spark as S

WINDOW = 50
#: Probes of one fingerprint in one task that may ask its owner; if there are more, all but the first document's are anchors unasked.
HOT = 64
#: Kind of messages with positions that the sending task has decided itself.
DECIDED = 9
_HITS = "doc long, key long, spans binary"


def _tokens(batch: pa.RecordBatch):
    """For slices of a batch(doc, key, text, ...): (rows, bytes, start, end, words before each bound, word hashes)."""
    data, bounds = K.column(batch.column(2))
    for first, last in K.slices(bounds):
        d = data[bounds[first] : bounds[last]]
        start, end, per = K.word_spans(d, bounds[first : last + 1] - bounds[first])
        yield first, last, d, start, end, per


def _docs(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)], 1).astype(np.int64)


def _groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts fingerprints, bounds of equal ones in it)."""
    if h.ndim == 1:
        order = np.argsort(h, kind="stable")
        x = h[order]
        new = x[1:] != x[:-1]
    else:
        order = np.lexsort((h[:, 1], h[:, 0]))
        x = h[order]
        new = (x[1:] != x[:-1]).any(1)
    return order, np.r_[0, np.flatnonzero(new) + 1]


def _decided(owners: int, doc: np.ndarray, pos: np.ndarray, docs: np.ndarray):
    """Messages with positions that need no owner, spread by document."""
    if len(doc):
        yield P.pack(owners, DECIDED, K.scramble(docs[doc].sum(1).astype(np.uint64)), doc, pos, docs, True, bare=True)


def _ask(owners: int, block: int):
    """Sends of a task's rolling windows those whose owner must be asked; reference blocks are those at multiples of block."""

    def send(h, doc, pos, docs):
        order, first = _groups(h)
        size = np.diff(first, append=len(h))
        d = docs[doc, 0]
        by = d[order]
        low, high = np.minimum.reduceat(by, first), np.maximum.reduceat(by, first)
        ref = pos % block == 0
        block_low = np.minimum.reduceat(np.where(ref[order], by, P.NO_ID), first)
        group = np.empty(len(h), np.int64)
        group[order] = np.repeat(np.arange(len(first)), size)
        low, high, block_low = low[group], high[group], block_low[group]
        anchor = d > block_low  # an earlier block is here
        waiting = np.bincount(group, ~anchor)[group]
        hot = waiting > HOT
        ask = ~anchor & (~hot | (d == low)) | (d == high)
        anchor |= hot & (d > low)
        yield from _decided(owners, doc[anchor], pos[anchor], docs)
        yield P.pack(owners, 1, h[ask], doc[ask], pos[ask], docs, True)
        ref &= d == block_low
        yield P.pack(owners, 0, h[ref], doc[ref], pos[ref], docs, True)

    return send


def _send_blocks(owners: int, block: int, window: int):
    def over(batches):
        out = P.Packer(owners, 1, True, _ask(owners, block))
        for batch in batches:
            ids = _docs(batch)
            for first, last, d, start, end, per in _tokens(batch):
                long_enough = np.diff(per) >= window
                h = K.windows(K.word_hashes(d, start, end), block)
                count = np.where(long_enough, np.diff(per) - block + 1, 0)
                at = K.runs(per[:-1], count)
                doc = np.repeat(np.arange(last - first), count)
                yield from out.add(h[at], doc, at - per[doc], ids[first:last])
        yield from out.flush()

    return over


def _spans_by_doc(docs: np.ndarray, index: np.ndarray, pos: np.ndarray):
    """A row for each document (doc, key) with its positions as int32 in a byte string."""
    if not len(index):
        return
    order = np.lexsort((pos, docs[index, 1], docs[index, 0]))
    d, p = docs[index[order]], pos[order].astype(np.int32)
    first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]).any(1)])
    cut = [*first.tolist(), len(p)]
    yield pa.RecordBatch.from_arrays([pa.array(d[first, 0]), pa.array(d[first, 1]), pa.array([p[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], names=["doc", "key", "spans"])


def _match_blocks(batches):
    """Positions of probes that meet a block of an earlier document, of blocks that meet a probe of a later one, and those decided before."""
    box = P.Inbox(batches, 2, 32)
    _, *decided = box.arrays(DECIDED)
    yield from _spans_by_doc(*decided)
    bh, bdocs, bindex, bpos = box.arrays(0)
    ph, pdocs, pindex, ppos = box.arrays(1)
    if not len(bh):
        return
    distinct, inverse = np.unique(bh, return_inverse=True)
    earliest = np.full(len(distinct), P.NO_ID)
    np.minimum.at(earliest, inverse, bdocs[bindex, 0])
    at = np.searchsorted(distinct, ph)
    at[at == len(distinct)] = 0
    known = np.flatnonzero(distinct[at] == ph)
    at, pindex, ppos = at[known], pindex[known], ppos[known]
    doc = pdocs[pindex, 0]
    latest = np.full(len(distinct), np.iinfo(np.int64).min)
    np.maximum.at(latest, at, doc)
    hit = earliest[at] < doc
    yield from _spans_by_doc(pdocs, pindex[hit], ppos[hit])
    ref = latest[inverse] > bdocs[bindex, 0]
    yield from _spans_by_doc(bdocs, bindex[ref], bpos[ref])


def _merged(before: int, after: int):
    """The positions of batch(doc, key, spans list), each as the range [p - before, p + after), as merged ranges: int32 pairs."""

    def over(batches):
        for batch in batches:
            out = []
            for spans in batch.column(2).to_pylist():
                p = np.unique(np.frombuffer(b"".join(spans), np.int32))
                first, end = np.maximum(p - before, 0), p + after
                new = np.r_[True, first[1:] > end[:-1]]
                out.append(np.stack([first[new], end[np.r_[new[1:], True]]], 1).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc", "key", "spans"])

    return over


def _ranges(spans: bytes | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of merged ranges, cut to n."""
    r = np.frombuffer(spans or b"", np.int32).reshape(-1, 2).astype(np.int64)
    first, end = np.minimum(r[:, 0], n), np.minimum(r[:, 1], n)
    return first, end


def _first_of(owners: int):
    """Sends of each window of a task only those in its first document; in later ones it is a repeat."""

    def send(h, doc, pos, docs):
        order, first = _groups(h)
        d = docs[doc, 0]
        low = np.empty(len(h), np.int64)
        low[order] = np.repeat(np.minimum.reduceat(d[order], first), np.diff(first, append=len(h)))
        late = d > low
        yield from _decided(owners, doc[late], pos[late], docs)
        yield P.pack(owners, 0, h[~late], doc[~late], pos[~late], docs, False)

    return send


def _send_windows(owners: int, window: int):
    """Fingerprints, of 128 bits, of the windows that start in the ranges of batch(doc, key, text, spans)."""

    def over(batches):
        out = P.Packer(owners, 0, False, _first_of(owners))
        for batch in batches:
            ids, spans = _docs(batch), batch.column(3).to_pylist()
            for first, last, d, start, end, per in _tokens(batch):
                starts = []
                for i in range(first, last):
                    n = int(per[i - first + 1] - per[i - first]) - window + 1
                    a, z = _ranges(spans[i], max(n, 0))
                    starts.append(K.runs(a, z - a))
                doc = np.repeat(np.arange(last - first), [len(s) for s in starts])
                pos = np.concatenate(starts) if starts else np.zeros(0, np.int64)
                if len(pos):
                    at = per[doc] + pos
                    h = np.stack([K.windows(K.word_hashes(d, start, end, seed), window, seed)[at] for seed in (0, 1)], 1)
                    yield from out.add(h, doc, pos, ids[first:last])
        yield from out.flush()

    return over


def _match_windows(batches):
    """Positions of windows that start in an earlier document too."""
    box = P.Inbox(batches, 2, 128)
    _, *decided = box.arrays(DECIDED)
    yield from _spans_by_doc(*decided)
    h, docs, index, pos = box.arrays(0)
    if not len(h):
        return
    order, first = _groups(h)
    d = docs[index, 0]
    low = np.empty(len(h), np.int64)
    low[order] = np.repeat(np.minimum.reduceat(d[order], first), np.diff(first, append=len(h)))
    hit = low < d
    yield from _spans_by_doc(docs, index[hit], pos[hit])


def _cut(window: int):
    """The kept text of batch(doc, key, text, spans, doc_id)."""

    def over(batches):
        for batch in batches:
            spans = batch.column(3).to_pylist()
            words, removed, texts = [], [], []
            for first, last, d, start, end, per in _tokens(batch):
                for i in range(first, last):
                    a, b = int(per[i - first]), int(per[i - first + 1])
                    gone = np.zeros(b - a + 1, np.int64)
                    for x, z in zip(*_ranges(spans[i], b - a), strict=True):
                        gone[x] += 1
                        gone[z] -= 1
                    keep = np.flatnonzero(np.cumsum(gone)[:-1] == 0) + a
                    words.append(b - a)
                    removed.append(b - a - len(keep))
                    if len(keep) == b - a and b > a:
                        text = b" ".join(d[start[a] : end[b - 1]].tobytes().split())
                    else:
                        raw = d.tobytes() if len(d) < 4096 else memoryview(d)
                        text = b" ".join(bytes(raw[s:e]) for s, e in zip(start[keep].tolist(), end[keep].tolist(), strict=True))
                    texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(4), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array([t.decode() for t in texts], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return over


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Removes repeats of window or more words from docs(doc_id, text, ...).

    A word goes if a window covers it whose words also start somewhere in a document
    with a smaller doc_id.  Returns for each row of docs: doc_id, n_words, n_removed,
    kept_sha256 and kept_text, the kept words joined by single spaces.

    Null and empty texts have no words.  A null doc_id counts as larger than all
    others.  Rows that repeat a doc_id remove nothing from each other.  Texts of any
    length are read whole; other columns are ignored.  window must be even.  Blocks
    are compared by 32 to 64 bits, which only choose what is looked at; windows, which
    decide, by fingerprints of 128 bits from two independent hashes of each word.
    """
    block = window // 2
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(P.NO_ID)).alias("doc"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    owners = S.partitions(texts)
    anchors = texts.select("doc", "key", "text").mapInArrow(_send_blocks(owners, block, window), P.MESSAGE)
    anchors = anchors.repartitionById(owners, F.col("owner")).mapInArrow(_match_blocks, _HITS)
    # windows [p - (window - block), p] contain the anchor at p
    anchors = anchors.groupBy("doc", "key").agg(F.collect_list("spans").alias("spans"))
    anchors = S.written(anchors.mapInArrow(_merged(window - block, 1), _HITS))
    around = texts.select("doc", "key", "text").join(S.small(anchors), ["doc", "key"])
    found = around.mapInArrow(_send_windows(owners, window), P.MESSAGE)
    found = found.repartitionById(owners, F.col("owner")).mapInArrow(_match_windows, _HITS)
    found = found.groupBy("doc", "key").agg(F.collect_list("spans").alias("spans"))
    found = S.written(found.mapInArrow(_merged(0, window), _HITS))
    cut = texts.join(S.small(found), ["doc", "key"], "left").select("doc", "key", "text", "spans", "doc_id")
    return cut.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


#: Exact SQL: every window of every document as a row; for small tables only.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS m FROM p GROUP BY s),
r AS (SELECT doc_id, list(i) AS hits FROM p JOIN f USING (s) WHERE m < doc_id GROUP BY doc_id),
g AS (SELECT doc_id, unnest(hits) AS i FROM r),
x AS (SELECT DISTINCT doc_id, i + j AS at FROM g, range(0, 50) t(j)),
k AS (SELECT d.doc_id, u.at, d.w[u.at] AS word FROM d, LATERAL (SELECT unnest(range(1, len(d.w) + 1)) AS at) u),
o AS (SELECT k.doc_id, string_agg(k.word, ' ' ORDER BY k.at) AS kept, count(*) AS n FROM k ANTI JOIN x ON k.doc_id = x.doc_id AND k.at = x.at GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(o.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(o.kept, '')) AS kept_sha256
FROM d LEFT JOIN o ON d.doc_id = o.doc_id
"""
