"""The pipeline's stages, each against what a brute-force version keeps of its own input."""

from collections import Counter
from itertools import combinations

import duckdb

import pytest

import corpus_pipeline as pipeline

from astrel.llm import mixing, toxicity

from tests.llm.test_operators import shingles




@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark, corpus):
    d = tmp_path_factory.mktemp("sf")
    near = " ".join(f"near{i}" for i in range(60))
    item = "what is the mass of a moving body of given energy in an open field near the sea at noon"
    rows = [*corpus, (400, corpus[3][1], "src1"), (401, None, None), (402, "clean words then " + item + " and more", "src2"), (None, "no id here at all today", "src1"), (None, near, "src1"), (None, near + " and more", "src2"), (9, corpus[3][1] + " x", "src1"), (9, corpus[5][1] + " x", "src1"), (403, "", "src3"), (403, "", "src3")]
    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "extra") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, more string")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "decontamination", "mixing"]
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    before, columns = rows(docs), docs.columns
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        got = rows(out)
        if name == "toxicity":
            want = before  # one-sided labels: every score is 1/2
        elif name == "exact_dedup":
            best = {}
            for i, t in before:
                best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
            assert sorted((i or -1, t or "") for i, t in got) == sorted((i or -1, t) for t, i in ((t, i if i >= 0 else None) for t, i in best.items()))
            want = got
        elif name == "ngram_join":
            sets = [(i, shingles(t)) for i, t in before]
            parent = list(range(len(sets)))

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b in combinations(range(len(sets)), 2):
                x, y = sets[a][1], sets[b][1]
                if x and 100 * len(x & y) >= 80 * len(x | y):
                    parent[find(a)] = find(b)
            groups = {}
            for k in range(len(sets)):
                groups.setdefault(find(k), []).append(k)
            # the smallest doc_id stays; of rows without one, or with the same, any one
            least = [min((before[k][0] for k in g if before[k][0] is not None), default=None) for g in groups.values()]
            wants = [[before[k] for k in g if before[k][0] == x] for g, x in zip(groups.values(), least, strict=True)]
            assert len(got) == len(wants) and all(sum(x in w for x in set(got)) == 1 for w in wants)
            want = got
        elif name == "decontamination":
            want = [x for x in before if x[0] != 402]
            assert len(want) == len(before) - 1
        else:
            assert out.columns[: len(columns)] == columns
            con = duckdb.connect()
            d = docs.select("doc_id", "text", "source").toArrow()  # noqa: F841
            repeats = Counter()
            for i, _, _, _, n, _ in con.execute(mixing.oracle(documents="d")).fetchall():
                repeats[i] += n
            assert Counter(i for i, _ in got) == +repeats
            continue
        assert out.columns == columns
        assert sorted(got, key=str) == sorted(want, key=str), name
        docs, before = spark.createDataFrame(out.collect(), docs.schema), got


def test_toxic_documents_go(spark, tmp_path):
    """The first stage drops the documents that the models predict to be toxic, those without an id too, and no other."""
    import random

    r = random.Random(5)
    plain, bad = [f"word{i}" for i in range(200)], ["zorkish", "blargly", "fnordic"]
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(plain) for _ in range(r.randint(10, 50))]
        if i % 5 == 0:
            for b in bad:
                w.insert(r.randrange(len(w)), b)
        rows.append((i if i % 50 else None, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame([*rows, (None, None), (601, "")], "doc_id long, text string")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    lab = spark.read.parquet(f"{tmp_path}/labels.parquet")
    out = pipeline.drop_toxic(spark, docs, str(tmp_path))
    got = Counter((x["doc_id"], x["text"]) for x in out.collect())
    judged = toxicity.toxicity(docs, lab).collect()
    # a brute-force stage: the operator's own verdicts, by text (equal texts have equal scores)
    model, curve = toxicity.train(docs, lab)
    import pyarrow as pa

    texts = sorted({t or "" for _, t in [*rows, (None, ""), (601, "")]})
    evidence = model.evidence(pa.array(texts)) @ curve
    toxic = {t for t, z in zip(texts, evidence.tolist(), strict=True) if 1 / (1 + 2.718281828459045 ** -z) >= toxicity.THRESHOLD}
    assert got == Counter(x for x in [*rows, (None, None), (601, "")] if (x[1] or "") not in toxic)
    assert sum(x["predicted"] for x in judged) == len(docs.collect()) - sum(got.values())
    caught = sum(any(b in t for b in bad) for t in toxic)
    assert caught == len(toxic) and caught > 100


def test_run(spark, folder):
    out = pipeline.run(spark, folder)
    assert out.count() > 50 and "repetition" in out.columns


def test_empty(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
