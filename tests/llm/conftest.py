import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, n_words string"


def make_rows(seed: int = 5, n: int = 60):
    """Small documents with copies, near copies, shared passages, junk, nulls, empties, a long text and repeated rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeghinorst") for _ in range(rng.randint(2, 7)))
    passage = [word() for _ in range(70)]
    rows, texts = [], []
    for i in range(n):
        words = [word() for _ in range(rng.choice([1, 3, 20, 80, 160]))]
        if i % 5 == 1 and texts:
            words = list(rng.choice(texts))
            if i % 10 == 1:
                words[rng.randrange(len(words))] = word()
        if i % 7 == 2:
            words[len(words) // 2 : len(words) // 2] = passage[: rng.choice([40, 50, 70])]
        texts.append(words)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words), ["en", "de", None][i % 3], None if i % 9 == 8 else f"s{i % 4}", None, "x", "y", "z"))
    rows += [(n, None, None, None, None, None, None, None), (n + 1, "", "en", "s0", 0, None, None, None), (n + 2, " \n\t", "en", "s1", 3, None, None, None), (n + 3, "é ü ñ ß — 日本", "de", "s1", 3, None, None, None)]
    rows.append((n + 4, " ".join(word() for _ in range(20_000)), "en", "s2", None, None, None, None))
    rows.append((n + 5, "$$$ 123 ... 456", "en", "s2", None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
    return df


@pytest.fixture(scope="session")
def hard(spark, docs):
    """Repeated rows and null ids beside the rest."""
    more = spark.createDataFrame([(None, "no id at all " * 30, "en", "s0", 1, None, None, None), (3, "same id, other text", "en", "s0", 1, None, None, None)], SCHEMA)
    return docs.unionByName(docs.filter("doc_id in (1, 2)")).unionByName(more)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
