import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, sig string, r string"


def words(rng, n, kinds=400, tag="w"):
    return [f"{tag}{rng.randrange(kinds)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus(spark):
    """Copies, near copies, shared passages, nulls, empty and blank texts, one long text, columns of clashing names."""
    rng = random.Random(3)
    texts: list[str | None] = [" ".join(words(rng, rng.choice([3, 8, 30, 120, 300]))) for _ in range(60)]
    for i in range(0, 30, 3):
        w = texts[i].split()
        texts.append(texts[i])
        if len(w) > 20:
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w).upper())
            texts.append(" ".join(words(rng, 40) + w[:60] + words(rng, 40)))
    long = words(rng, 4000, 2000)
    texts += [None, "", "  \n\t ", "one", "one", "ONE", " ".join(long), " ".join(long[:3000]), "é ñ ß 日本 🙂", "a b c d e"]
    rows = [(i, t, None, "s", 1, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), {i: t or "" for i, t in enumerate(texts)}


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated rows and null ids."""
    return spark.createDataFrame([(5, "same words here and there again", None, None, None, None, None, None)] * 2 + [(None, "same words here and there again", None, None, None, None, None, None), (6, None, None, None, None, None, None, None)], SCHEMA)
