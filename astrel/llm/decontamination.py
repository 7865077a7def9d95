"""Benchmark decontamination by template canonicalisation.

Words are stripped of signs at their ends and lower-cased; numbers, names
(capitalised words inside a sentence) and units become typed placeholders.
Windows of the resulting template are hash-joined with those of the benchmark,
so a question with other figures or names still meets its template.  Windows of
the lower-cased words themselves, numbers and names included, are joined beside
them, so that a verbatim copy is found whatever its words and capitals are.

Items of one template form a class, and documents meet classes, so that a document
that shares a window with thousands of variants of one question costs one row.
Each alignment of a document with an item must then use its slots consistently: a
name or unit of the item always stands for one of the document, and so does a
number, unless another word follows it ("12 apples and 12 pears" has two slots).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrel.llm import _kernel as K
from astrel.llm import _spark as S

#: Words of a template window; shorter items are one window each.
WINDOW = 8
#: Words of a template window that must not be placeholders: with fewer it is too common to tell anything.  Items of fewer words in all aren't looked for.
LITERAL = 4
#: Share of an item's words that aligned windows must cover for the document to be contaminated.
COVERAGE = 0.5
UNITS = (
    "mm cm dm m km in ft yd mi mile miles inch inches foot feet metre metres meter meters kilometre kilometres kilometer kilometers g kg mg t lb lbs oz "
    "gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces s sec secs second seconds min mins minute minutes h hr hrs hour hours "
    "day days week weeks month months year years l ml cl litre litres liter liters gallon gallons cent cents dollar dollars euro euros usd eur gbp percent "
    "kmh mph hz khz mhz ghz w kw kwh v volt volts watt watts j joule joules n newton newtons pa c f k degree degrees"
).split()
_HIT = "h long, length int, doc_id long, key long, pos int, at array<int>, slots array<long>"
#: Fingerprints of the index up to which documents are filtered by all of them; beyond, by a Bloom filter of 2**BLOOM bits.
KNOWN, BLOOM = 1_000_000, 27
#: Stands for a null doc_id.
NO_ID = (1 << 63) - 1
#: Sets the fingerprints of verbatim windows apart from those of templates.
_VERBATIM = 0x5BE0CD19137E2179
_TAGS = {1: 0x1B873593CC9E2D51, 2: 0x2545F4914F6CDD1D, 3: 0x6A09E667F3BCC909}


def _unit_hashes() -> np.ndarray:
    data, bounds = K.column(pa.array(UNITS))
    start, end, _ = K.word_spans(data, bounds)
    return np.sort(K.word_hashes(data, start, end))


_UNITS: list[np.ndarray] = []


def templates(data: np.ndarray, bounds: np.ndarray):
    """(template hash of each word, its own hash, its type: 0 literal, 1 number, 2 name, 3 unit; words before each bound)."""
    if not _UNITS:
        _UNITS.append(_unit_hashes())
    start, end, per = K.word_spans(data, bounds)
    if not len(start):
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, np.int8), per
    # strip signs: the next byte that isn't one from the left, the last from the right
    at = np.arange(len(data))
    plain = ~K.SIGN[data]
    following = np.minimum.accumulate(np.where(plain, at, len(data))[::-1])[::-1]
    preceding = np.maximum.accumulate(np.where(plain, at, -1))
    raw_end, doc = end, np.repeat(np.arange(len(bounds) - 1), np.diff(per))
    s, e = following[start], preceding[end - 1] + 1
    keep = s < e
    lines = np.r_[0, np.cumsum(data == 10)]
    last = data[raw_end - 1]
    stop = (last == 46) | (last == 33) | (last == 63) | (last == 58) | (last == 59)
    begins = np.ones(len(start), bool)
    begins[1:] = stop[:-1] | (doc[1:] != doc[:-1]) | (lines[start[1:]] > lines[raw_end[:-1]])
    s, e, begins, doc = s[keep], e[keep], begins[keep], doc[keep]
    per = np.searchsorted(doc, np.arange(len(bounds)))
    own = K.word_hashes(K.LOWER[data], s, e)
    byte, second = data[s], data[np.minimum(s + 1, e - 1)]
    digits = (byte >= 48) & (byte <= 57)
    capital = (byte >= 65) & (byte <= 90) & ((second < 65) | (second > 90)) & (e - s > 1)
    accented = (byte == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    kind = np.zeros(len(s), np.int8)
    kind[(capital | accented) & ~begins] = 2
    units = _UNITS[0]
    # a unit is one only after a number
    after_number = np.r_[False, digits[:-1] & (doc[1:] == doc[:-1])] if len(digits) else digits
    kind[after_number & (units[np.minimum(np.searchsorted(units, own), len(units) - 1)] == own)] = 3
    kind[digits] = 1
    h = own.copy()
    for k, tag in _TAGS.items():
        h[kind == k] = np.uint64(tag)
    return h, own, kind, per


def template_windows(data: np.ndarray, bounds: np.ndarray, length: int):
    """(fingerprint, document, position, first word, whether a template, words, kinds) of windows of so many words: templates with enough literal words, then all verbatim ones."""
    h, own, kind, per = templates(data, bounds)
    at, count = K.starts_of_windows(per, length)
    literal = np.r_[0, np.cumsum(kind == 0)]
    doc = np.repeat(np.arange(len(count)), count)
    pos = at - per[doc]
    keep = literal[at + length] - literal[at] >= min(LITERAL, length)
    if not len(at):
        return np.zeros(0, np.uint64), doc, pos, at, keep, own, kind
    w = np.concatenate([K.windows(h, length)[at[keep]], K.windows(own, length, _VERBATIM)[at]])
    return w, np.r_[doc[keep], doc], np.r_[pos[keep], pos], np.r_[at[keep], at], np.arange(len(w)) < keep.sum(), own, kind


def _rows(w, doc, pos, at, template, own, kind, length, ids, keys):
    where = [np.flatnonzero(kind[a : a + length]) if t else np.zeros(0, np.int64) for a, t in zip(at.tolist(), template.tolist(), strict=True)]
    slots = [own[a + x].astype(np.int64).tolist() for a, x in zip(at.tolist(), where, strict=True)]
    n = len(w)
    return pa.RecordBatch.from_arrays(
        [pa.array(w.astype(np.int64)), pa.array(np.full(n, length, np.int32)), ids.take(pa.array(doc)), keys.take(pa.array(doc)), pa.array(pos.astype(np.int32)), pa.array([x.tolist() for x in where], pa.list_(pa.int32())), pa.array(slots, pa.list_(pa.int64()))],
        names=["h", "length", "doc_id", "key", "pos", "at", "slots"],
    )


class Known:
    """Which fingerprints may be in the index: a sorted table of them, or the words of a Bloom filter."""

    def __init__(self, table: np.ndarray | None, bloom: np.ndarray | None = None):
        self.table, self.bloom = table, bloom

    def __call__(self, w: np.ndarray) -> np.ndarray:
        """Positions of the fingerprints that may be."""
        if self.bloom is None:
            if not hasattr(self, "bits"):
                self.bits = np.zeros(1 << 20, bool)
                self.bits[(self.table >> np.uint64(44)).astype(np.int64)] = True
            some = np.flatnonzero(self.bits[(w >> np.uint64(44)).astype(np.int64)])
            return some[self.table[np.minimum(np.searchsorted(self.table, w[some]), len(self.table) - 1)] == w[some]]
        some = np.arange(len(w))
        for shift in (0, BLOOM):
            x = (w[some] >> np.uint64(shift)) & np.uint64((1 << BLOOM) - 1)
            some = some[(self.bloom[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1) == 1]
        return some


def _known(index: DataFrame) -> Known:
    """A filter of at most 8 * KNOWN or 2**BLOOM / 8 bytes for the fingerprints of an index."""
    h = S.written(index.select("h").distinct())
    if h.limit(KNOWN + 1).count() <= KNOWN:
        table = np.sort(np.array([r[0] for r in h.collect()], np.int64).astype(np.uint64))
        return Known(table if len(table) else np.zeros(1, np.uint64))
    mask = (1 << BLOOM) - 1
    bit = F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", BLOOM).bitwiseAND(mask))).alias("bit")
    words = h.select(bit).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
    bloom = np.zeros(1 << (BLOOM - 6), np.uint64)
    bloom[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint64)
    return Known(None, bloom)


def _windows(lengths: list[int], known):
    """Template windows of batch(doc_id, key, text); known: a broadcast filter of fingerprints to keep, or None for all."""

    def over(batches):
        for batch in batches:
            data, bounds = K.column(batch.column(2))
            for first, last in K.slices(bounds):
                d, b = data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
                for length in lengths:
                    w, doc, pos, at, template, own, kind = template_windows(d, b, length)
                    if known is not None:
                        some = known.value(w)
                        w, doc, pos, at, template = w[some], doc[some], pos[some], at[some], template[some]
                    if len(w):
                        yield _rows(w, doc + first, pos, at, template, own, kind, length, batch.column(0), batch.column(1))

    return over


def _index(lengths: list[int]):
    """Windows of batch(item_id, text): (h, length, item_id, item_pos, verbatim)."""

    def over(batches):
        for batch in batches:
            data, bounds = K.column(batch.column(1))
            for length in lengths:
                w, doc, pos, _, template, *_ = template_windows(data, bounds, length)
                n = len(w)
                yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int64)), pa.array(np.full(n, length, np.int32)), batch.column(0).take(pa.array(doc)), pa.array(pos.astype(np.int32)), pa.array(~template)], names=["h", "length", "item_id", "item_pos", "verbatim"])

    return over


def _items(batches):
    """(item_id, words, sign of the template, positions of its slots, what tells the slots apart) of batch(item_id, text)."""
    for batch in batches:
        data, bounds = K.column(batch.column(1))
        h, own, kind, per = templates(data, bounds)
        sign, at, slot = [], [], []
        for a, b in zip(per[:-1].tolist(), per[1:].tolist(), strict=True):
            sign.append(int(K.windows(h[a:b], b - a)[0].astype(np.int64)) if b > a else 0)
            where = np.flatnonzero(kind[a:b])
            following = np.r_[own[a + 1 : b], np.zeros(min(b - a, 1), np.uint64)]
            at.append(where.tolist())
            slot.append(np.where(kind[a:b] == 1, K.mix(own[a:b], following), own[a:b])[where].astype(np.int64).tolist())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(per)), pa.array(sign, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(slot, pa.list_(pa.int64()))], names=["item_id", "words", "sign", "slot_at", "slot"]
        )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """Finds items of benchmark(item_id, text, ...) in docs(doc_id, text, ...).

    Returns for each row of docs: doc_id, contaminated, n_items, item_ids (ascending),
    coverage and text_key (xxhash64 of the text).  A document is contaminated if
    consistent alignments cover at least the share coverage of some item's words;
    item_ids lists those items, and the column coverage has the largest share, or 0.

    Null and empty texts, an empty benchmark and items with fewer than four words
    contaminate nothing.  Repeated rows are judged alike; equal items are each
    reported; rows that share a doc_id are told apart by their texts.  Texts are
    read whole; other columns are ignored.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    about = S.written(items.mapInArrow(_items, "item_id long, words long, sign long, slot_at array<int>, slot array<long>").filter(F.col("words") >= LITERAL).distinct())
    lengths = [r[0] for r in about.select(F.least(F.col("words"), F.lit(window)).cast("int").alias("n")).distinct().orderBy("n").collect()]  # at most window
    index = items.mapInArrow(_index(lengths), "h long, length int, item_id long, item_pos int, verbatim boolean").join(S.small(about.select("item_id", "words", "sign")), "item_id")
    index = S.written(index.filter((F.col("length") == window) | (F.col("length") == F.col("words"))))
    by_class = S.small(S.written(index.filter("not verbatim").select("h", "length", "sign", "words", "item_pos").distinct()))
    by_item = S.small(S.written(index.filter("verbatim").select("h", "length", "item_id", "item_pos").distinct()))
    known = docs.sparkSession.sparkContext.broadcast(_known(index))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("id"))
    hits = S.written(keyed.select("doc_id", "key", "text").mapInArrow(_windows(lengths, known), _HIT).distinct())
    shift = (F.col("pos") - F.col("item_pos")).alias("shift")
    reach = F.array_distinct(F.flatten(F.collect_list(F.sequence("item_pos", F.col("item_pos") + F.col("length") - 1)))).alias("covered")
    values = F.arrays_zip(F.transform("at", lambda x: x + F.col("item_pos")).alias("at"), F.col("slots").alias("value"))
    in_class = S.written(hits.join(by_class, ["h", "length"]).groupBy("doc_id", "key", "sign", "words", shift).agg(reach, F.array_distinct(F.flatten(F.collect_list(values))).alias("filled")))
    verbatim = S.written(hits.join(by_item, ["h", "length"]).groupBy("doc_id", "key", "item_id", shift).agg(reach))

    # items looked at one by one: all of a class that a document may cover far enough, and those that it holds words of verbatim
    far = in_class.groupBy("doc_id", "key", "sign", "words").agg(F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("n")).filter(F.col("n") >= coverage * F.col("words"))
    wanted = far.join(S.small(about.select("sign", "words", "item_id")), ["sign", "words"]).select("doc_id", "key", "item_id").union(verbatim.select("doc_id", "key", "item_id")).distinct()
    wanted = wanted.join(S.small(about), "item_id")
    slots = F.map_from_arrays("slot_at", "slot")
    pairs = F.transform("filled", lambda x: F.struct(slots[x["at"]].alias("slot"), x["value"].alias("value")))
    aligned = in_class.join(wanted, ["doc_id", "key", "sign", "words"]).select("doc_id", "key", "item_id", "shift", "covered", pairs.alias("pairs"))
    consistent = F.size(F.array_distinct("pairs")) == F.size(F.array_distinct("pairs.slot"))
    aligned = aligned.select("doc_id", "key", "item_id", "shift", "covered", consistent.alias("ok")).union(verbatim.select("doc_id", "key", "item_id", "shift", "covered", F.lit(True)))
    aligned = aligned.groupBy("doc_id", "key", "item_id", "shift").agg(F.flatten(F.collect_list("covered")).alias("covered"), F.every("ok").alias("ok")).filter("ok")
    found = aligned.groupBy("doc_id", "key", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("n")).join(S.small(about.select("item_id", "words")), "item_id")
    found = found.select("doc_id", "key", "item_id", (F.col("n") / F.col("words")).alias("share")).filter(F.col("share") >= coverage)
    found = found.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("share").alias("coverage"))
    found = S.small(S.written(found))
    none = F.coalesce("item_ids", F.array().cast("array<long>"))
    return keyed.select("doc_id", "key", "id").join(found, ["doc_id", "key"], "left").select(
        F.col("id").alias("doc_id"), (F.size(none) > 0).alias("contaminated"), F.size(none).cast("long").alias("n_items"), none.alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.col("key").alias("text_key")
    )
