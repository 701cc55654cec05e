"""Small tables for the tests of the text operators."""

import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rnd: random.Random, words: int) -> str:
    vocabulary = ["the", "of", "and", "to", "in", "a"] + ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(3, 8))) for _ in range(400)]
    return " ".join(rnd.choice(vocabulary) for _ in range(words))


@pytest.fixture(scope="session")
def corpus(spark):
    """Prose with copies, near copies, shared passages, and every odd case."""
    rnd = random.Random(3)
    texts = [prose(rnd, rnd.randint(1, 260)) for _ in range(120)]
    passage = prose(rnd, 45)
    for i in range(20, 60, 3):
        texts[i] = texts[i] + " " + passage + "\n" + prose(rnd, 20)
    for i in range(60, 75):
        words = texts[0].split()
        words[rnd.randrange(len(words))] = f"edit{i}"
        texts[i] = " ".join(words)
    for i in range(75, 85):
        texts[i] = texts[1]
    texts += ["", None, " \n\t ", "one two", "one two", "One TWO", "é è 日本 " * 30, "x" * 200_000, "word " * 5000]
    rows = [(i, t, "en", f"src{i % 4}", None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[6], None, None, None), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(4)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
