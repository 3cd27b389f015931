import random

import pytest


@pytest.fixture(scope="session")
def corpus(spark, data):
    """(doc_id, text) rows: the small table, passages cut and shared, near copies, ties, nulls, odd spaces, repeated rows."""
    rng = random.Random(7)
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    texts = [t for _, t in base]
    rows = list(base)
    for j in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            t = rng.choice(texts)
            a = rng.randrange(len(t) + 1)
            parts.append(t[a : a + rng.choice([150, 199, 200, 201, 230, 400, 700])])
        rows.append((1000 + j, " ".join(parts)))
    for j in range(30):
        words = rng.choice(texts[:30]).split(" ")
        words[rng.randrange(len(words))] = f"zz{rng.randrange(9)}"
        rows.append((2000 + j, " ".join(words)))
    rows += [(3000, "a" * 1000), (3001, "ab" * 300), (3002, "abc " * 200), (3003, None), (3004, ""), (3004, ""), (None, "x y z " * 90), (None, texts[0]), (5, texts[1]), (3005, " \n" * 400), (3006, "é" * 150), (3007, "One"), (3008, "ONE two"), (3009, "tail  \t two"), (3010, "x\x1cy z")]
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The rows as a table with columns that clash with names used inside the operators."""
    return spark.createDataFrame([(i, t, 1, 2.0, "n") for i, t in corpus], "doc_id long, text string, k_id int, n double, spans string").repartition(5)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string")
