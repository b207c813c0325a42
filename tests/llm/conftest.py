import random

import pytest

CLASHES = ["part", "kind", "tie", "score", "bucket", "line", "dest", "pid", "key", "n", "tid", "did", "c0", "sends", "predicted"]


def words(rng, n, size=400):
    return " ".join("".join(rng.choice("etaoin shrdlu".replace(" ", "")) for _ in range(rng.randint(2, 7))) + str(rng.randint(0, size)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Nulls, empty and very long texts, ties, copies, near copies, shared passages."""
    rng = random.Random(5)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    passage = words(rng, 60)
    out = [None, "", " ", "\n\n", "a", base, base, " ".join(near), base.upper(), passage + "\n" + words(rng, 30), words(rng, 30) + "\n" + passage, "x" * 5000, "ab " * 3000, "é ü 日本語 ñ", "one two three four", "One  two\tthree four"]
    out += [words(rng, 20) + ".\n" + words(rng, 15) for _ in range(10)]
    out += ["\n".join(words(rng, 8) for _ in range(60)), words(rng, 9000, 10**6)]
    return list(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHES:
        df = df.selectExpr("*", f"'{c}' as {c}")
    return df


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
