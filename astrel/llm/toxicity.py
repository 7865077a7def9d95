"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary labelled texts, are interpolated with
absolute discounting down to a level that both share:

    p_c(w | v) = (c_c(v w) - D_c)+ / c_c(v .)  +  D_c n_c(v .) / c_c(v .) * p_c(w)
    p_c(w)     = (n_c(. w) - E_c)+ / n_c(. .)  +  E_c W_c / n_c(. .) * p(w)
    p(w)       = (n(. w) + 1/2) / (n(. .) + (W + 1)/2)

n counts distinct neighbours, so an expression that only occurs in copies of one
text stays rare and is left to the shared level; W counts distinct words.  The
discounts are estimated from counts of counts over all counted rows: of n1 things
seen once and n2 seen twice, n1 / (n1 + 2 n2).  A text's evidence is the
difference of its length-normalised log-likelihoods: over the whole text, and over
its most telling words, so that a remark in a long text isn't averaged away.  A
logistic curve turns the evidence into a score from 0 to 1.  It is fitted on a
bounded sample of the training rows, each without its own counts (leave-one-out).

Counts cover every labelled training row and are exact for 64-bit fingerprints.
They are tables sorted by fingerprint in the shared folder, one file for each
hash range, that grow with the input; workers look keys up in mapped files, so
neither the driver nor a worker ever holds the model.
"""

from __future__ import annotations

import io
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrel.llm import _kernel as K
from astrel.llm import _spark as S

#: Labelled rows on which the curve is fitted at most (but for chance), taken by hash of doc_id; the models count all rows.
CURVE_ROWS = 20_000
#: Words that count as most telling.
TELLING = 5
#: Sightings at which a ratio counts half as telling: one that rests on a single sighting is mostly chance.
SUPPORT = 10.0
FEATURES = 7
THRESHOLD = 0.7


def _words(batch_text: pa.Array):
    """For slices of a text column: (fingerprint of each word, of the word before it, words before each bound)."""
    data, bounds = K.column(batch_text)
    for first, last in K.slices(bounds):
        d = K.LOWER[data[bounds[first] : bounds[last]]]
        start, end, per = K.word_spans(d, bounds[first : last + 1] - bounds[first], K.SIGN)
        w = K.word_hashes(d, start, end)
        v = np.empty_like(w)
        v[1:] = w[:-1]
        v[per[:-1][per[:-1] < len(w)]] = 0  # the beginning of a text
        yield first, last, w, v, per


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return K.scramble(v * np.uint64(0xA0761D6478BD642F) + w)


def _owner(key: np.ndarray, owners: int) -> np.ndarray:
    """Owners hold equal hash ranges, in the order of the keys."""
    return (((key >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)).astype(np.int64)


def _sum_by(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    distinct, inverse = np.unique(key, return_inverse=True)
    return distinct, *(np.bincount(inverse, v, len(distinct)).astype(np.int64) for v in values)


_PARTS = "part int, keys binary, counts binary"


def _coded(column: np.ndarray) -> bytes:
    """Counts in a byte each, and those of 255 or more once more with their places."""
    big = np.flatnonzero(column >= 255)
    return b"".join(x.tobytes() for x in (np.uint32([len(big)]), np.minimum(column, 255).astype(np.uint8), big.astype(np.uint32), column[big].astype(np.uint32)))


def _decoded(coded: bytes, n: int, columns: int) -> np.ndarray:
    """The n counts of each of several coded columns."""
    out, at = np.empty((n, columns), np.uint32), 0
    for c in range(columns):
        big = int(np.frombuffer(coded, np.uint32, 1, at)[0])
        out[:, c] = np.frombuffer(coded, np.uint8, n, at + 4)
        at += 4 + n
        out[np.frombuffer(coded, np.uint32, big, at), c] = np.frombuffer(coded, np.uint32, big, at + 4 * big)
        at += 8 * big
    return out


def _parts(part: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Rows (part, keys, counts) of arrays (one row a key) that are cut by part."""
    order = np.argsort(part, kind="stable")
    part, keys, counts = part[order], keys[order], counts[order]
    first = np.flatnonzero(np.diff(part, prepend=-1))
    cut = [*first.tolist(), len(part)]
    spans = list(zip(cut, cut[1:], strict=False))
    # column after column, which compresses better
    return pa.RecordBatch.from_arrays(
        [pa.array(part[first], pa.int32()), pa.array([keys[a:b].T.tobytes() for a, b in spans], pa.binary()), pa.array([b"".join(_coded(c) for c in counts[a:b].T) for a, b in spans], pa.binary())],
        names=["part", "keys", "counts"],
    )


def _read(batches, width: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for b in batches:
        for k, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            keys.append(np.frombuffer(k, np.uint64).reshape(width, -1).T)
            counts.append(_decoded(c, len(keys[-1]), columns))
    if not keys:
        return np.zeros((0, width), np.uint64), np.zeros((0, columns), np.uint32)
    return np.concatenate(keys), np.concatenate(counts)


def _count_pairs(owners: int):
    """Bigram counts by class of batch(text, toxic), summed in the task."""

    def over(batches):
        held, size = [], 0

        def flush():
            v, w, toxic = (np.concatenate(x) for x in zip(*held, strict=True))
            pair, at, inverse = np.unique(_pair(v, w), return_index=True, return_inverse=True)
            c1 = np.bincount(inverse, toxic, len(pair))
            return _parts(_owner(pair, owners), np.stack([v[at], w[at]], 1), np.stack([np.bincount(inverse, minlength=len(pair)) - c1, c1], 1))

        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False) > 0
            for first, last, w, v, per in _words(batch.column(0)):
                held.append((v, w, np.repeat(label[first:last], np.diff(per))))
                size += len(w)
                if size > 1 << 21:
                    yield flush()
                    held.clear()
                    size = 0
        if size:
            yield flush()

    return over


def _put(folder: str, name: str, keys: np.ndarray, counts: np.ndarray) -> None:
    """Keep sorted keys and their counts as two files; a repeated task replaces them by equal ones."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path)
    for part, a in (("keys", keys), ("counts", counts.astype(np.uint16 if counts.max(initial=0) <= 0xFFFF else np.uint32))):
        out = io.BytesIO()
        np.save(out, a)
        aside = f"{path}/.{uuid.uuid4().hex}"
        with system.open_output_stream(aside) as f:
            f.write(out.getbuffer())
        system.move(aside, f"{path}/{name}.{part}.npy")


def _mapped(folder: str, name: str):
    """The mapped array of a file, or None where there is no such file."""
    system, path = fs.FileSystem.from_uri(folder)
    path = f"{path}/{name}.npy"
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return None
    if not isinstance(system, fs.LocalFileSystem):  # map a local copy
        with tempfile.NamedTemporaryFile(suffix=".npy") as f:
            fs.copy_files(path, f.name, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
            return np.load(f.name, mmap_mode="r")
    return np.load(path, mmap_mode="r")


def _once_twice(counts: np.ndarray) -> list[float]:
    return [float((counts[:, c] == k).sum()) for c in (0, 1) for k in (1, 2)]


def _sum_pairs(owners: int, folder: str):
    """Owner of a range of bigrams: keeps their counts and hands on what they add to contexts and words."""

    def over(batches):
        K.tidy()
        keys, counts = _read(batches, 2, 2)
        if not len(keys):
            return
        pair, at, inverse = np.unique(_pair(keys[:, 0], keys[:, 1]), return_index=True, return_inverse=True)
        v, w = keys[at].T
        c0, c1 = (np.bincount(inverse, counts[:, i], len(pair)).astype(np.int64) for i in (0, 1))
        _put(folder, f"pairs-{int(_owner(pair[:1], owners)[0])}", pair, np.stack([c0, c1], 1))
        both, n = np.r_[v, w], len(pair)
        # n_0, n_1, n of a word after others, c_0, c_1, n_0, n_1 of it before others
        seen0, seen1, zero = c0 > 0, c1 > 0, np.zeros(n)
        word, *sums = _sum_by(both, *(np.r_[a, b] for a, b in ((zero, seen0), (zero, seen1), (zero, np.ones(n)), (c0, zero), (c1, zero), (seen0, zero), (seen1, zero))))
        batch = _parts(_owner(word, owners), word[:, None], np.stack(sums, 1))
        stats = pa.array([_once_twice(np.stack([c0, c1], 1)), *[None] * (len(batch) - 1)], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*batch.columns, stats], names=["part", "keys", "counts", "stats"])

    return over


def _sum_words(owners: int, folder: str):
    def over(batches):
        K.tidy()
        batches = list(batches)
        keys, counts = _read(batches, 1, 7)
        if not len(keys):
            return
        word, *sums = _sum_by(keys[:, 0], *counts.T)
        sums = np.stack(sums, 1)
        _put(folder, f"words-{int(_owner(word[:1], owners)[0])}", word, sums)
        n = sums[:, :3]
        pairs = np.sum([np.zeros(4), *(x for b in batches for x in b.column(3).to_pylist() if x)], 0)
        stats = [pairs.tolist()], [[*_once_twice(n), *n.sum(0).tolist(), *(n > 0).sum(0).tolist()]]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())) for x in stats], names=["pairs", "words"])

    return over


def _fold(c):
    """Fold of a row: crc32 of doc_id as text; by its remainder modulo 3, 1 is held out."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def discounts(stats: np.ndarray) -> np.ndarray:
    """n1 / (n1 + 2 n2) of both classes; below 1, and 1/2 where nothing was seen once."""
    n1, n2 = stats[:4].reshape(2, 2).T
    return np.where(n1 > 0, n1 / np.maximum(n1 + 2 * np.maximum(n2, 1), 1), 0.5)


class Model:
    """Scores words from the counts kept in a folder; itself it only holds sums, so that it is cheap to send."""

    opened: dict = {}

    def __init__(self, folder: str, owners: int, pairs: np.ndarray, words: np.ndarray):
        self.folder, self.owners = folder, owners
        self.pair_discount, self.word_discount = discounts(pairs), discounts(words)
        self.types, self.distinct = words[4:7], words[7:10]

    def look(self, table: str, key: np.ndarray, columns: int) -> np.ndarray:
        """Counts of ascending keys; 0 for those that weren't counted."""
        out = np.zeros((len(key), columns))
        cuts = np.searchsorted(_owner(key, self.owners), np.arange(self.owners + 1))
        for o in np.flatnonzero(np.diff(cuts)).tolist():
            at = (self.folder, table, o)
            if at not in self.opened:
                if self.opened and next(iter(self.opened))[0] != self.folder:
                    self.opened.clear()
                self.opened[at] = [_mapped(self.folder, f"{table}-{o}.{x}") for x in ("keys", "counts")]
            known, counts = self.opened[at]
            if known is not None:
                k = key[cuts[o] : cuts[o + 1]]
                i = np.minimum(np.searchsorted(known, k), len(known) - 1)
                hit = np.flatnonzero(known[i] == k)
                out[cuts[o] + hit] = counts[i[hit]]
        return out

    def ratios(self, w: np.ndarray, v: np.ndarray, per: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log p_toxic(w | v) - log p_ordinary(w | v) of each word; the same, and that of p(w), shrunk where they rest on few sightings.

        own: the class of each text, if the texts were counted and are to be judged without their own counts.
        """
        word, at = np.unique(np.r_[w, v], return_inverse=True)
        of_w, of_v = at[: len(w)], at[len(w) :]
        pair, of_pair = np.unique(_pair(v, w), return_inverse=True)
        known, c = self.look("words", word, 7), self.look("pairs", pair, 2)[of_pair]
        n, t, u = known[of_w, :3], known[of_v, 3:5], known[of_v, 5:7]
        types = np.broadcast_to(self.types, n.shape)
        if own is not None and len(w):
            doc = np.repeat(np.arange(len(per) - 1), np.diff(per))
            y = own[doc].astype(np.int64)
            row = np.arange(len(w))
            _, first, same, times = np.unique(doc * len(pair) + of_pair, return_index=True, return_inverse=True, return_counts=True)
            # what the text's bigrams add: their counts, and a neighbour where no other text of the class, or of both, has them
            alone, unique = c[first, y[first]] == times, c[first].sum(1) == times
            for table, by in ((t, of_v), (n, of_w)):
                _, group = np.unique(doc * len(word) + by, return_inverse=True)
                if table is t:
                    t[row, y] -= np.bincount(group[first], times)[group]
                    u[row, y] -= np.bincount(group[first], alone)[group]
                else:
                    n[row, y] -= np.bincount(group[first], alone)[group]
                    n[:, 2] -= np.bincount(group[first], unique)[group]
            c[row, y] -= times[same]
            types = types.copy()
            types[row, y] -= np.bincount(doc[first], alone, len(own))[doc]
            types[:, 2] -= np.bincount(doc[first], unique, len(own))[doc]
        types = np.maximum(types, 1)
        shared = (n[:, 2:] + 0.5) / (types[:, 2:] + 0.5 * (self.distinct[2] + 1))
        left = np.where(self.types[:2] > 0, self.word_discount * np.maximum(self.distinct[:2], 1) / types[:, :2], 1)
        word_p = np.maximum(n[:, :2] - self.word_discount, 0) / types[:, :2] + left * shared
        total = np.maximum(t, 1)
        pair_p = np.maximum(c - self.pair_discount, 0) / total
        p = np.maximum(pair_p + np.where(t > 0, self.pair_discount * u / total, 1) * word_p, 1e-30)
        # sightings that the toxic estimate rests on: of the bigram and of the word, by their parts in it
        part = np.minimum(pair_p[:, 1] / p[:, 1], 1)
        rests = part * c[:, 1] + (1 - part) * n[:, 1]
        whole, word = (x[:, 1] - x[:, 0] for x in (np.log(p), np.log(word_p)))
        return whole, whole * rests / (rests + SUPPORT), word * n[:, 1] / (n[:, 1] + SUPPORT)

    def evidence(self, texts: pa.Array, own: np.ndarray | None = None) -> np.ndarray:
        """A row for each text: mean log ratio; mean and largest of the most telling bigrams' and words' ratios; log of its length; 1."""
        out = []
        for first, last, w, v, per in _words(texts):
            whole, *telling = self.ratios(w, v, per, None if own is None else own[first:last])
            n, docs = np.diff(per), last - first
            doc = np.repeat(np.arange(docs), n)
            columns = [np.bincount(doc, whole, docs) / np.maximum(n, 1)]  # summed text by text, whatever stands around it
            top = np.arange(len(w)) - per[:-1][doc] < TELLING
            for r in telling:
                order = np.lexsort((-r, doc))
                largest = np.zeros(docs)
                largest[n > 0] = r[order][per[:-1][n > 0]]
                columns += [np.bincount(doc[top], r[order][top], docs) / np.maximum(np.minimum(n, TELLING), 1), largest]
            out.append(np.stack([*columns, np.log1p(n), np.ones(docs)], 1))
        return np.concatenate(out) if out else np.zeros((0, FEATURES))


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression with a small ridge, by Newton's method."""
    scale = np.maximum(x.std(0), 1e-6)
    scale[-1] = 1.0
    z, b = x / scale, np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(len(b))
        step = np.linalg.solve(hessian, z.T @ (y - p) - 0.05 * b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b / scale


def train(docs: DataFrame, labels: DataFrame) -> tuple[Model, np.ndarray]:
    """(model, weights of the curve) from docs(doc_id, text) and labels(doc_id, toxic).

    Rows whose crc32(doc_id) modulo 3 is 1 are never read as labels.  A doc_id with
    several labels is toxic if any of them says so; null labels count as none.
    """
    fold = _fold(F.col("doc_id"))
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).dropna().filter(fold % 3 != 1)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # about CURVE_ROWS of the rows: all whose hash lies below a bound, so that no task gathers candidates
    share = min(1.0, CURVE_ROWS / max(known.count(), 1))
    sampled = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = S.text_ids(docs).join(S.small(known), "doc_id").select("text", "toxic", "doc_id")
    owners = min(S.partitions(docs.select("text")), 1 << 12)
    folder = S.scratch(docs.sparkSession)
    pairs = rows.select("text", "toxic").mapInArrow(_count_pairs(owners), _PARTS)
    sums = pairs.repartitionById(owners, F.col("part")).mapInArrow(_sum_pairs(owners, folder), _PARTS + ", stats array<double>")
    words = sums.repartitionById(owners, F.col("part")).mapInArrow(_sum_words(owners, folder), "pairs array<double>, words array<double>").collect()  # a row for each owner
    model = Model(folder, owners, np.sum([np.zeros(4), *(r.pairs for r in words)], 0), np.sum([np.zeros(10), *(r.words for r in words)], 0))

    def evidence(batch):
        x = model.evidence(batch.column(0), (batch.column(1).to_numpy(zero_copy_only=False) > 0).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    held = S.map_arrow(rows.filter(sampled).select("text", "toxic"), evidence, "x array<double>, toxic int").collect()
    y = np.array([float(r.toxic > 0) for r in held])
    if len(set(y.tolist())) < 2:  # nothing to fit: no evidence either way
        return model, np.zeros(FEATURES)
    x = np.array([r.x for r in held])
    order = np.lexsort((y, *x.T))  # sums in one order, so that reruns agree
    return model, fit_curve(x[order], y[order])


def scorer(model, curve: np.ndarray):
    """An Arrow UDF from text to score; null and empty texts have one and the same score."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        z = np.clip(model.evidence(texts) @ curve, -30, 30)
        return pa.array(1 / (1 + np.exp(-z)))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs(doc_id, text, ...).

    labels(doc_id, toxic, ...) may be empty or one-sided; every score is then 1/2.
    A score depends on the text alone: equal texts have equal scores, null texts
    score as empty ones, and lang, source, doc_id and labels have no part in it.
    Texts are read whole; other columns of either table are ignored.
    """
    score = scorer(*train(docs, labels))
    out = S.text_ids(docs).select("doc_id", score("text").alias("score"))
    return out.select("doc_id", (_fold(F.col("doc_id")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
