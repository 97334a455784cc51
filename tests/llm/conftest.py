import random

import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "ra", "so", "tiv") for b in ("", "da", "fen", "gur", "hal", "jor", "pel", "zim")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with copies, near copies, shared passages, nulls, empty, white and one very long text."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(5, 120)) for _ in range(60)]
    passage = prose(rng, 30)
    texts += [texts[4], texts[4], texts[7] + " x", "A " + texts[9], texts[11].upper()]
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 20) for _ in range(4)]
    near = texts[20].split()
    for k in range(5):
        w = list(near)
        w[(7 * k) % len(w)] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", " \n\t ", "é ü 日本 " * 20, "aaaa" * 60, "aaaa" * 60, "x", "\n".join([prose(rng, 12)] * 3), prose(rng, 9000), "a b c d"]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in corpus]
    return spark.createDataFrame(rows, KINDS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], KINDS)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with further columns whose names clash with those that operators make, one row without an id."""
    from pyspark.sql import functions as F

    wide = docs
    for c in ("node", "root", "fp", "key", "n", "chunk", "bucket", "removed", "component_id", "shard", "line", "kept"):
        wide = wide.withColumn(c, F.lit("clash"))
    return wide.union(wide.filter("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))).union(wide.filter("doc_id = 5"))
