"""N-gram Jaccard join with adaptive multi-match prefixes.

Texts are sets of word 5-grams.  Copies of one set are first collapsed to a class.

1. Prefix of each class in hash order.  A set of n n-grams whose partners share at
   least a of them sends its first n - a + l n-grams; partners then share l of
   those.  The owners of the hash ranges return only n-grams that two classes
   sent, with their number of classes: its cost in candidates.
2. A class that got back fewer n-grams than it must share has no partner and is
   done.  The others are joined on a second prefix, rarest n-grams first.  Each
   class lengthens this prefix by the estimated cost: it picks the number of
   matches k that makes (pairs touched by the prefix) + (cost of verifying the
   pairs expected to share k) least.  Prefixes of k and k' matches find a pair
   when it shares min(k, k') n-grams in them.
3. Classes are gathered in blocks by the most shared n-gram of their second
   prefix, which near copies agree on, and prefixes are joined as blocks: two
   blocks are candidates if they share as many prefix n-grams as the least k in
   them asks for.  So a group of g near copies makes (g / BLOCK)^2 candidates.
4. Each pair of blocks is a tile: its whole sets are compared by matrix products,
   and it answers with a number of links for each class and with edges that span
   the linked classes, never with pairs.

Frequent n-grams (a passage that a third of all texts share) come last in the
second order, so they are used only by classes that hold little else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrel.llm import _kernel as K
from astrel.llm import _packed as P
from astrel.llm import _spark as S

NGRAM = 5
PERCENT = 80
#: Matches that the first prefix asks for: one, and one more for so many n-grams.
STEP = 8
#: Cost of verifying a pair, in pairs touched; most matches that a second prefix may ask for.
VERIFY, MOST = 8.0, 12
#: Classes of a block, and n-grams of all of them together, on average; groups of more are split by hash.
BLOCK, BLOCK_GRAMS = 1024, 1 << 20
#: Blocks that share an n-gram and are joined in one task; those of more are spread over several.
SPLIT = 1000
#: An n-gram of a tile goes into the matrix product if it touches at least one in so many of its pairs.
DENSE = 200

def least_shared(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """n-grams that a set of n must share with any set of Jaccard similarity percent / 100 or more."""
    return -(-n * percent // 100)


def matches(n: np.ndarray) -> np.ndarray:
    """Matches asked for in the first prefix of a set of n; never falls as n grows."""
    return 1 + n // STEP


def ngram_sets(data: np.ndarray, bounds: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, bounds): for each text its distinct word n-grams, ascending; a shorter text is one n-gram."""
    d = K.LOWER[data]
    start, end, per = K.word_spans(d, bounds)
    h = K.word_hashes(d, start, end)
    at, count = K.starts_of_windows(per, n)
    doc = np.repeat(np.arange(len(count)), count)
    grams = K.windows(h, n)[at] if len(at) else np.zeros(0, np.uint64)
    size = np.diff(per)
    for k in range(1, n):  # whole sequences of the short texts
        short = np.flatnonzero(size == k)
        if len(short):
            grams = np.concatenate([grams, K.windows(h, k, 1000)[per[short]]])
            doc = np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    if len(grams):
        new = np.r_[True, (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])]
        grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(len(bounds)))


def _sketch(percent: int):
    """doc_id, set size, two signatures of the set, its first prefix in hash order, and the text's key."""

    def over(batches):
        for batch in batches:
            data, bounds = K.column(batch.column(1))
            sizes, s1, s2, prefix = [], [], [], []
            for first, last in K.slices(bounds):
                g, b = ngram_sets(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
                n = np.diff(b)
                take = np.minimum(n, n - least_shared(n, percent) + matches(n))
                for x, out in ((g, s1), (K.scramble(g ^ np.uint64(0x5851F42D4C957F2D)), s2)):
                    total = np.r_[np.uint64(0), np.cumsum(x, dtype=np.uint64)]
                    out.append(total[b[1:]] - total[b[:-1]])
                sizes.append(n)
                prefix += [g[i : i + t].tobytes() for i, t in zip(b[:-1].tolist(), take.tolist(), strict=True)]
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cat(sizes)), pa.array(cat(s1).astype(np.int64)), pa.array(cat(s2).astype(np.int64)), pa.array(prefix, pa.binary()), batch.column(2)], names=["doc_id", "n", "s1", "s2", "prefix", "text_key"])

    return over


def _send(owners: int):
    """Prefixes of batch(cid, n, prefix) to the owners of their n-grams."""

    def over(batches):
        out = P.Packer(owners, 0, False)
        for batch in batches:
            ids = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1).astype(np.int64)
            raw = batch.column(2).to_pylist()
            size = np.array([len(x) // 8 for x in raw])
            for first, last in K.slices(np.r_[0, np.cumsum(size * 8)], 1 << 22):
                h = np.frombuffer(b"".join(raw[first:last]), np.uint64)
                doc = np.repeat(np.arange(last - first), size[first:last])
                yield from out.add(h, doc, np.zeros(len(h), np.int64), ids[first:last])
        yield from out.flush()

    return over


def _shared(batches):
    """n-grams that two or more classes sent: for each class its n-grams and their numbers of classes."""
    h, docs, index, _ = P.Inbox(batches, 2, 64).arrays(0)
    if not len(h):
        return
    _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    keep = np.flatnonzero(count[inverse] > 1)
    h, index, count = h[keep], index[keep], count[inverse[keep]]
    order = np.argsort(docs[index, 0], kind="stable")
    h, index, count = h[order], index[order], count[order]
    cid = docs[index, 0]
    first = np.flatnonzero(np.diff(cid, prepend=cid[:1] - 1)).tolist()
    cut = [*first, len(cid)]
    if first:
        yield pa.RecordBatch.from_arrays(
            [pa.array(cid[first]), pa.array(docs[index[first], 1]), pa.array([h[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()), pa.array([count[a:b].astype(np.uint32).tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())],
            names=["cid", "n", "h", "c"],
        )


def choose(count: np.ndarray, must: int) -> tuple[int, int]:
    """(k, length): matches and length of the second prefix that cost least.

    count: classes that hold each n-gram, ascending; must: matches that a partner has among them.
    A pair found by k matches touches k entries, so at most (entries / k) pairs are verified.
    """
    k = np.arange(1, min(must, MOST) + 1)
    length = len(count) - must + k
    touched = np.cumsum(count - 1)[length - 1]
    best = int(np.argmin(touched + VERIFY * touched / k))
    return int(k[best]), int(length[best])


def _second(percent: int):
    """Second prefixes of batch(cid, n, h list, c list): rows (cid, n, k, gram, lead); lead: the most shared one of them."""

    def over(batches):
        for batch in batches:
            cids, ns, ks, grams, leads = [], [], [], [], []
            for cid, n, hs, cs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                h, c = np.frombuffer(b"".join(hs), np.uint64), np.frombuffer(b"".join(cs), np.uint32).astype(np.int64)
                must = int(matches(least_shared(np.int64(n), percent)))
                if len(h) < must:
                    continue
                order = np.lexsort((h, c))
                k, length = choose(c[order], must)
                order = order[:length]
                most = order[np.searchsorted(c[order], c[order[-1]])]
                grams.append(h[order].astype(np.int64))
                cids.append(np.full(length, cid))
                ns.append(np.full(length, n))
                ks.append(np.full(length, k))
                leads.append(np.full(length, h[most].astype(np.int64)))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (cids, ns, ks, grams, leads)], names=["cid", "n", "k", "gram", "lead"])

    return over


def _sets(batches):
    """Whole sets of batch(cid, copies, text)."""
    for batch in batches:
        data, bounds = K.column(batch.column(2))
        out = []
        for first, last in K.slices(bounds):
            g, b = ngram_sets(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
            out += [g[i:j].tobytes() for i, j in zip(b[:-1].tolist(), b[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["cid", "copies", "grams"])


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Matrix of the numbers of n-grams that each set of the left shares with each of the right."""
    na, nb = len(left), len(right)
    size = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    exact = np.float32 if max(size[0].max(), size[1].max()) < 1 << 24 else np.float64
    out = np.zeros((na, nb), exact)
    grams, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    at_a, at_b = at[: size[0].sum()], at[size[0].sum() :]
    ca, cb = np.bincount(at_a, minlength=len(grams)), np.bincount(at_b, minlength=len(grams))
    touched = ca * cb
    dense = touched * DENSE >= max(na * nb, 1)
    dense &= touched > 0
    row_a, row_b = np.repeat(np.arange(na), size[0]), np.repeat(np.arange(nb), size[1])
    column = np.cumsum(dense) - 1
    width = int(dense.sum())
    step = max((1 << 22) // max(na, nb), 64)
    in_a, in_b = np.flatnonzero(dense[at_a]), np.flatnonzero(dense[at_b])
    col_a, col_b = column[at_a[in_a]], column[at_b[in_b]]
    for first in range(0, width, step):
        parts = []
        for rows, cols, n in ((row_a[in_a], col_a, na), (row_b[in_b], col_b, nb)):
            here = (cols >= first) & (cols < first + step)
            m = np.zeros((n, min(step, width - first)), exact)
            m[rows[here], cols[here] - first] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    # n-grams that few pairs share, pair by pair
    in_a = np.flatnonzero((touched[at_a] > 0) & ~dense[at_a])
    if len(in_a):
        order = np.argsort(at_b, kind="stable")
        begin = np.searchsorted(at_b[order], np.arange(len(grams)))
        count = cb[at_a[in_a]]
        flat = out.reshape(-1)
        cuts = np.r_[0, np.cumsum(count)]
        first = 0
        while first < len(in_a):
            last = max(int(np.searchsorted(cuts, cuts[first] + (1 << 20), "right")) - 1, first + 1)
            some = in_a[first:last]
            cols = row_b[order[K.runs(begin[at_a[some]], count[first:last])]]
            pair, times = np.unique(np.repeat(row_a[some], count[first:last]) * nb + cols, return_counts=True)
            flat[pair] += times
            first = last
    return out


def links_of(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix of the links between sets of the left and of the right."""
    same = common(left, right)
    na, nb = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    out = np.empty(same.shape, bool)
    for i in range(0, len(left), 256):
        s = same[i : i + 256].astype(np.int64)
        out[i : i + 256] = 100 * s >= percent * (na[i : i + 256, None] + nb[None] - s)
    return out


def spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """(row, node) edges that connect what the links between rows and columns connect; nodes are rows, then columns."""
    rows, cols = links.shape
    new_row, new_col, out = links.any(1), np.ones(cols, bool), []
    for i in range(rows):
        if not new_row[i]:
            continue
        front, new_row[i] = np.array([i]), False
        while len(front):
            found = np.flatnonzero(links[front].any(0) & new_col)
            new_col[found] = False
            out += [(i, rows + int(j)) for j in found]
            front = np.flatnonzero(links[:, found].any(1) & new_row) if len(found) else found
            new_row[front] = False
            out += [(i, int(j)) for j in front]
    return out


def _tiles(percent: int):
    """Answers of the tiles in batch(b1, b2, side, cid, copies, grams), sorted by tile: (cid, others, root)."""

    def answer(tile: pa.Table):
        side = tile["side"].to_numpy()
        cid, copies = tile["cid"].to_numpy(), tile["copies"].to_numpy()
        sets = [np.frombuffer(g, np.uint64) for g in tile["grams"].to_pylist()]
        alone = not side.any()
        a = np.flatnonzero(side == 0)
        b = a if alone else np.flatnonzero(side == 1)
        if not len(a) or not len(b):
            return
        links = links_of([sets[i] for i in a], [sets[i] for i in b], percent)
        if alone:
            np.fill_diagonal(links, False)
        root = {}
        for i, j in spanning(links):
            j = j % len(a) if alone else j
            if i != j:
                root.setdefault(j, i)
        ids = cid[a] if alone else cid[np.r_[a, b]]
        others = links @ copies[b] if alone else np.r_[links @ copies[b], copies[a] @ links]
        some = np.flatnonzero(others)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(others[some].astype(np.int64)), pa.array([int(ids[root[i]]) if i in root else None for i in some.tolist()], pa.int64())], names=["cid", "others", "root"])

    def over(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            b1, b2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(b1):
                continue
            cuts = np.flatnonzero((b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1])) + 1
            if held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != (int(b1[0]), int(b2[0])):
                yield from answer(pa.Table.from_batches(held))
                held = []
            cuts = [0, *cuts.tolist(), len(b1)]
            for first, last in zip(cuts, cuts[1:], strict=False):
                held.append(batch.slice(first, last - first))
                if last < len(b1):
                    yield from answer(pa.Table.from_batches(held))
                    held = []
        if held:
            yield from answer(pa.Table.from_batches(held))

    return over


def components(edges: DataFrame) -> DataFrame:
    """(cid, component): smallest id reachable from each end of edges(lo, hi).

    Each round takes the least label of the neighbours and then the label of that
    label, so distances halve; labels are written after each round.  Ends when no
    label falls.
    """
    both = S.written(edges.select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("hi").alias("b")), F.struct(F.col("hi").alias("a"), F.col("lo").alias("b")))).alias("e")).select("e.*"))
    labels = S.written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "cid"))
    while True:
        heard = both.join(labels.withColumnRenamed("cid", "b"), "b").groupBy(F.col("a").alias("cid")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("cid").alias("label"), F.col("label").alias("far"))
        step = labels.join(jump, "label").join(heard, "cid")
        new = S.written(step.select("cid", F.least("label", "far", "near").alias("label"), (F.least("far", "near") < F.col("label")).alias("fell")))
        labels = new.select("cid", "label")
        if not new.filter("fell").limit(1).count():
            return labels.withColumnRenamed("label", "component")


def ngram_join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Groups of similar texts in docs(doc_id, text, ...).

    Two documents link when 100 * common n-grams >= percent * n-grams in either.
    Returns for each row of docs: doc_id, n_shingles, n_similar (documents linked
    directly), component_id (smallest doc_id reachable by links, itself included),
    text_key (xxhash64 of the text, to tell apart rows that share a doc_id) and
    group_id, one number for each group of two or more linked documents, else null.

    Null, empty and blank texts have no n-grams and no links; their component is
    their doc_id.  Rows with a null doc_id count in the n_similar of others; their
    component_id is the smallest doc_id of their group, or null.  Repeated rows and
    rows that share a doc_id are documents of their own.  Texts are read whole;
    other columns are ignored.  n-grams are compared by 64-bit fingerprints, classes
    by two of them and the size.
    """
    texts = S.text_ids(docs, F.xxhash64("text").alias("text_key"))
    owners = S.partitions(texts.select("doc_id", "text"))
    sketch = S.written(texts.mapInArrow(_sketch(percent), "doc_id long, n long, s1 long, s2 long, prefix binary, text_key long"))
    key = ["s1", "s2", "n"]
    # a class is known by its sets' signatures; the id it gets when it is written is a short name for them
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_key")).alias("first")
    classes = sketch.filter("n > 0").groupBy(*key).agg(first, F.count("*").alias("copies"), F.min("prefix").alias("prefix"))
    classes = S.written(classes.select(*key, F.monotonically_increasing_id().alias("cid"), F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("text_key"), "copies", "prefix"))
    sent = classes.select("cid", "n", "prefix").mapInArrow(_send(owners), P.MESSAGE).repartitionById(owners, F.col("owner"))
    shared = sent.mapInArrow(_shared, "cid long, n long, h binary, c binary")
    shared = shared.groupBy("cid", "n").agg(F.collect_list("h").alias("h"), F.collect_list("c").alias("c"))
    second = S.written(shared.mapInArrow(_second(percent), "cid long, n long, k long, gram long, lead long"))

    # blocks of classes with one lead, split by hash where they are many or large
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("long")
    many = S.written(second.filter("gram = lead").groupBy("lead").agg(parts.alias("parts")).filter("parts > 1"))
    block = F.xxhash64("lead", F.pmod(F.xxhash64("cid"), F.coalesce("parts", F.lit(1)))).alias("block")
    rows = second.join(S.small(many), "lead", "left").select("cid", "n", "k", "gram", block, (F.col("gram") == F.col("lead")).alias("leads"))
    members = S.written(S.few(rows.filter("leads").select("cid", "block"), owners))
    post = S.written(rows.groupBy("gram", "block").agg(F.min("k").alias("k")))
    often = S.written(post.groupBy("gram").agg(F.count("*").alias("blocks")).filter("blocks > 1"))
    post = post.join(often, "gram").withColumn("salts", F.ceil(F.col("blocks") / SPLIT).cast("int"))
    a = post.select("gram", F.col("block").alias("b1"), F.col("k").alias("k1"), F.pmod(F.xxhash64("block"), F.col("salts")).cast("int").alias("salt"))
    b = post.select("gram", F.col("block").alias("b2"), F.col("k").alias("k2"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    touched = a.join(b, ["gram", "salt"]).filter("b1 < b2").groupBy("b1", "b2").agg(F.count("*").alias("same"), F.min(F.least("k1", "k2")).alias("k"))
    across = touched.filter("same >= k").select("b1", "b2")
    within = members.groupBy("block").agg(F.count("*").alias("classes")).filter("classes > 1").select(F.col("block").alias("b1"), F.col("block").alias("b2"))
    tiles = S.written(across.union(within))

    sides = tiles.select("b1", "b2", F.explode(F.when(F.col("b1") == F.col("b2"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    sides = sides.withColumn("block", F.when(F.col("side") == 0, F.col("b1")).otherwise(F.col("b2")))
    wanted = S.written(S.few(sides.join(members, "block").select("b1", "b2", "side", "cid"), owners))
    named = classes.join(wanted.select("cid").distinct(), "cid").select(F.col("first_id").alias("d"), F.col("text_key").alias("t"), "cid", "copies")
    # one text for each class: that of its first document
    named = S.small(S.written(S.few(named, owners)))
    whole = texts.join(named, texts["doc_id"].eqNullSafe(F.col("d")) & (texts["text_key"] == F.col("t"))).select("cid", "copies", "text")
    sets = whole.mapInArrow(_sets, "cid long, copies long, grams binary").dropDuplicates(["cid"])
    shipped = wanted.join(sets, "cid").select("b1", "b2", "side", "cid", "copies", "grams").repartition("b1", "b2").sortWithinPartitions("b1", "b2")
    answers = S.written(shipped.mapInArrow(_tiles(percent), "cid long, others long, root long"))

    degree = answers.groupBy("cid").agg(F.sum("others").alias("others"))
    edges = answers.filter("root is not null").select(F.least("cid", "root").alias("lo"), F.greatest("cid", "root").alias("hi"))
    about = classes.select(*key, "cid", "copies", "first_id").join(degree, "cid", "left").filter("copies > 1 or others is not null")
    about = S.written(S.few(about.join(components(S.few(edges, owners)), "cid", "left").withColumn("group_id", F.coalesce("component", "cid")).drop("component"), owners))
    least = about.groupBy("group_id").agg(F.min("first_id").alias("component_id"))
    about = about.join(least, "group_id").select(*key, (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_similar"), "component_id", "group_id")
    return sketch.drop("prefix").join(S.small(S.written(S.few(about, owners))), key, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"),
        F.when(F.col("group_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "text_key", "group_id",
    )


#: Exact SQL: an n-gram is a row, and every pair that shares one is counted; for small tables only.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, hash(s) AS s FROM (
    SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r AS (SELECT x AS a, x AS b FROM e UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b),
m AS (SELECT a, min(b) AS m FROM r GROUP BY a),
k AS (SELECT x, count(*) AS k FROM e GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(k.k, 0) AS BIGINT) AS n_similar, coalesce(m.m, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.x = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""
