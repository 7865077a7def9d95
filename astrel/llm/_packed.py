"""Packed exchange: fingerprints travel to the owners of their hash ranges as byte arrays.

A message holds, for one owner, the fingerprints of a run of documents in text
order: the fingerprints, the runs of documents they belong to, and word positions
as gaps.  That is 6 to 12 bytes a fingerprint, against some 40 for a row each, and
owners work on whole arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from astrel.llm import _kernel as K

MESSAGE = "owner int, kind int, h binary, docs binary, runs binary, gaps binary"
_FIELDS = [("owner", pa.int32()), ("kind", pa.int32()), ("h", pa.binary()), ("docs", pa.binary()), ("runs", pa.binary()), ("gaps", pa.binary())]
#: Stands for a null doc_id: larger than any other.
NO_ID = (1 << 63) - 1


def pack(owners: int, kind: int, h: np.ndarray, doc: np.ndarray, pos: np.ndarray, docs: np.ndarray, short: bool, bare: bool = False) -> pa.RecordBatch:
    """Messages for all owners.

    h: fingerprints of 64 bits, or of 128 as two columns, of which the first tells
    the owner; doc: index of each one's document in docs, ascending; pos: its word
    position.  docs: one or more int64 a document.  short: send 32 bits of each
    fingerprint instead of 64; bare: none.
    """
    owner, order = K.split_owners(h if h.ndim == 1 else h[:, 0], owners)
    cuts = np.searchsorted(owner[order], np.arange(owners + 1))
    h, doc, pos = h[order], doc[order], pos[order]
    value = h[:0] if bare else h.astype(np.uint32) if short else h
    rows = []
    for o in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[o], cuts[o + 1]
        d = doc[a:b]
        first = np.flatnonzero(np.diff(d, prepend=-1))
        gaps = np.diff(pos[a:b], prepend=0)
        gaps[first] = pos[a:b][first]
        wide = gaps.max(initial=0) > 0xFFFF
        rows.append((o, kind, value[a:b].tobytes(), docs[d[first]].tobytes(), np.diff(first, append=b - a).astype(np.uint32).tobytes(), gaps.astype(np.uint32 if wide else np.uint16).tobytes()))
    cols = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


class Packer:
    """Gathers fingerprints of several slices before they are packed, so that messages stay long when owners are many."""

    def __init__(self, owners: int, kind: int, short: bool, send=None):
        """send: makes messages of (fingerprints, index of document, positions, documents); by default all are packed as they are."""
        self.send = send or (lambda *held: [pack(owners, kind, *held, short)])
        self.limit = min(max(32 * owners, 1 << 17), 1 << 22)
        self.parts: list[tuple] = []
        self.held = self.base = 0

    def add(self, h: np.ndarray, doc: np.ndarray, pos: np.ndarray, docs: np.ndarray):
        if len(h):
            self.parts.append((h, doc + self.base, pos, docs))
            self.base += len(docs)
            self.held += len(h)
            if self.held >= self.limit:
                yield from self.flush()

    def flush(self):
        if self.parts:
            h, doc, pos, docs = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            self.parts, self.held, self.base = [], 0, 0
            yield from self.send(h, doc, pos, docs)


class Inbox:
    """What one owner task received: messages by kind, each as whole arrays."""

    def __init__(self, batches, width: int, bits: int):
        K.tidy()
        self.rows: dict[int, list] = {}
        self.width, self.bits = width, bits
        for b in batches:
            for kind, *rest in zip(*(b.column(i).to_pylist() for i in range(1, 6)), strict=True):
                self.rows.setdefault(kind, []).append(rest)

    def arrays(self, kind: int):
        """(fingerprints, doc rows (n x width), index into them, positions) of all messages of a kind."""
        rows = self.rows.pop(kind, [])
        shape = (-1, 2) if self.bits == 128 else (-1,)
        if not rows:
            return np.zeros(0, np.uint64).reshape(shape), np.zeros((0, self.width), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        hs, docs, index, pos, base = [], [], [], [], 0
        for h, d, r, g in rows:
            run = np.frombuffer(r, np.uint32).astype(np.int64)
            dd = np.frombuffer(d, np.int64).reshape(-1, self.width)
            gaps = np.frombuffer(g, np.uint16 if len(g) == 2 * run.sum() else np.uint32).astype(np.int64)
            total = np.cumsum(gaps)
            first = np.cumsum(run) - run
            total -= np.repeat(total[first] - gaps[first], run)
            hs.append(np.frombuffer(h, np.uint32 if self.bits == 32 else np.uint64).reshape(shape))
            docs.append(dd)
            index.append(np.repeat(np.arange(len(run)) + base, run))
            pos.append(total)
            base += len(run)
        return np.concatenate(hs), np.concatenate(docs), np.concatenate(index), np.concatenate(pos)
