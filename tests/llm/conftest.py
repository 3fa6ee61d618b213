import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, starts string, least long, size string, key1 string"


def make_text(rng, n, words=400):
    return "".join(f"w{rng.randint(0, words)}" + rng.choice([" ", " ", " ", ". ", "\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    rng = random.Random(5)
    base = [make_text(rng, rng.choice([3, 12, 40, 80, 150])) for _ in range(60)]
    passage = make_text(rng, 70)
    texts = [*base]
    for t in base[:12]:
        words = t.split(" ")
        words[len(words) // 2] = "changed"
        texts += [t, " ".join(words)]
    texts += [make_text(rng, 30) + passage + make_text(rng, 20) for _ in range(8)]
    texts += [None, "", "   \n ", "x" * 50_000, "one", "One", "a b c", "A B C", make_text(rng, 6000), "héllo wörld ünïcode 中文 " * 12]
    rng.shuffle(texts)
    rows = [(i * 3 % 211, t, "en" if i % 3 else None, f"s{i % 2}") for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (rows[7][0], "another text under a doc_id that is taken", "en", "s1"), (None, base[3], "en", None)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns that clash with names used inside the operators."""
    return spark.createDataFrame([(*r, 1, "x", 2, "y", "z") for r in corpus], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
