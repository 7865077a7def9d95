"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token's symbols form a doubly linked list; a heap holds the ranks of its
adjacent pairs.  The lowest-ranked pair, leftmost among equals, is merged again
and again; the count is the number of initial symbols less the merges, so no
identifier is ever looked up or emitted.  Counts of pre-tokens are remembered per
Python worker in a table of bounded size: forgetting costs time, never results.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from astrel.llm import _kernel as K
from astrel.llm import _spark as S

#: Contractions, then letters, numbers and other signs with one space before them, then white space.
PATTERN = (
    r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Pre-tokens remembered by a worker, and the longest one remembered.
REMEMBERED, LONGEST = 400_000, 64


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


class Counter(dict):
    """Counts tokens of texts for a byte-level byte-pair vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        self.symbol = [vocabulary[c] for c in _byte_letters()]
        self.merge: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[vocabulary[a] << 20 | vocabulary[b]] = rank, vocabulary[a + b]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))).split if self.special else None

    def merged(self, raw: bytes) -> int:
        """Tokens of one pre-token."""
        n = len(raw)
        sym = [self.symbol[b] for b in raw]
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        merge, heap = self.merge, []
        for i in range(n - 1):
            if hit := merge.get(sym[i] << 20 | sym[i + 1]):
                heap.append((hit[0], i))
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i = heapq.heappop(heap)
            if sym[i] < 0 or (j := after[i]) < 0:
                continue
            hit = merge.get(sym[i] << 20 | sym[j])
            if hit is None or hit[0] != rank:  # one of the two has been merged since
                continue
            sym[i], sym[j], left = hit[1], -1, left - 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if hit := merge.get(sym[i] << 20 | sym[k]):
                    heapq.heappush(heap, (hit[0], i))
            if (h := before[i]) >= 0 and (hit := merge.get(sym[h] << 20 | sym[i])):
                heapq.heappush(heap, (hit[0], h))
        return left

    def __missing__(self, token: str) -> int:
        n = self.merged(token.encode("utf-8"))
        if len(token) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of a text; special strings count one each."""
        parts = self.split(text) if self.split and any(s in text for s in self.special) else [text]
        get = self.__getitem__
        return len(parts) - 1 + sum(sum(map(get, self.find(p))) for p in parts)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One Counter per worker and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) for each row of docs(doc_id, text, ...).

    path: a byte-level BPE file of the tokenizers library, readable on every
    executor.  Null and empty texts have 0 bytes and 0 tokens; repeated rows give
    repeated results; texts are counted whole, whatever their length.  Other
    columns are ignored.
    """

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        texts = batch.column(1)
        _, bounds = K.column(texts)
        tokens = np.fromiter((c.count(t) if t else 0 for t in texts.to_pylist()), np.int64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(tokens), pc.greater(pa.array(tokens), limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return S.map_arrow(S.text_ids(docs), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
