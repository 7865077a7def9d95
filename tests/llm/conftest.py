import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key long, h int, spans string"


@pytest.fixture(scope="session")
def make(spark):
    """documents with extra columns whose names clash with those the operators use inside."""

    def docs(rows):
        return spark.createDataFrame([(i, t, None, s, None, "x", 1, 2, None) for i, t, s in rows], SCHEMA)

    return docs


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a long text."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    return [
        (1, None, "a"), (2, "", None), (3, " \t\n", "b"), (4, "one", "a"), (5, "one", "a"), (5, "one", "a"), (None, "one", None), (None, None, None), (6, long, "b"),
        (7, long + " tail", "c"), (8, "x" * 30_000, "a"), (9, "Ünï çødé\u2003Ä", "é"), (10, "one", "z"),
    ]


@pytest.fixture(scope="session")
def corpus():
    """Prose with copies, near copies, shared passages and benchmark passages."""
    import random

    r = random.Random(7)
    words = ["".join(r.choice(["an", "er", "th", "io", "le", "ou", "st"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = [text(70) for _ in range(3)]
    rows = []
    for i in range(160):
        t = text(r.choice([3, 5, 20, 60, 150, 300]))
        if i % 4 == 0 and rows:
            base = r.choice(rows)[1].split(" ")
            for _ in range(r.choice([0, 0, 1, 3])):
                base[r.randrange(len(base))] = r.choice(words)
            t = " ".join(base)
        if i % 5 == 0:
            t = t + " " + r.choice(passage) + " " + text(5)
        rows.append((i, t, f"src{i % 7}" if i % 3 else "hot"))
    return rows
