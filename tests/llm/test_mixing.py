import numpy as np
import pytest
from pyspark.sql import functions as F

from hotspan.llm.mixing import MixingConfig, fit_rates, mixed, mixing_report


def brute(n, p, targets, steps=20_000):
    """The same least squares by many plain projected steps."""
    rates, inverse = np.ones(len(n)), np.linalg.pinv((p * n[:, None]).T @ p)
    for _ in range(steps):
        rates = np.maximum(0, rates + p @ (inverse @ (targets - p.T @ (n * rates))))
    return p.T @ (n * rates)


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(1)
    n, p = rng.integers(1, 300, 60).astype(float), rng.dirichlet([0.5, 0.3, 0.2], 60).round(6)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n bigint, p array<double>")
    for shares in ([0.5, 0.3, 0.2], [0.9, 0.05, 0.05]):
        targets = np.array(shares) * n.sum()
        config = MixingConfig(steps=60)
        rates = np.ones(60)
        for step in fit_rates(members, targets, config):
            rates = np.maximum(0, rates + p @ np.array(step))
        totals = p.T @ (n * rates)
        assert (rates >= 0).all() and np.abs(totals - brute(n, p, targets)).sum() <= 0.02 * n.sum()


@pytest.fixture(scope="module")
def labelled(spark):
    import random
    rnd = random.Random(12)
    rows, labels = [], []
    for i in range(240):
        kind = i % 4
        words = [rnd.choice(["stone", "river", "cloud", "green", "walk"]) for _ in range(60)]
        if kind == 2:
            words = [w + "|" for w in words]
        if kind == 3:
            words[::20] = ["idiot"] * 3
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(kind != 2), int(kind == 3)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, rate int"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_classifier_on_held_out_rows(labelled):
    docs, labels = labelled
    out = mixing_report(docs, labels.where("doc_id < 120")).where("doc_id >= 120").join(labels, "doc_id").collect()
    hits = [int(np.argmax(r["posterior"])) == (2 if r["toxic"] else 0 if r["quality"] else 1) for r in out]
    assert sum(hits) >= 0.95 * len(hits)


def test_every_toxic_word_counts(spark):
    """Thirty toxic words, some not in ASCII letters, each in documents of their own."""
    import random
    rnd = random.Random(5)
    bad = ["слово", "mérde", "ñoño"] + ["zz" + "".join(rnd.choice("bcdfgh") for _ in range(6)) for _ in range(27)]
    rows, labels = [], []
    for i in range(1200):
        words = [rnd.choice(["stone", "river", "cloud", "green", "walk"]) for _ in range(60)]
        if i % 4 == 3:
            words[::20] = [bad[i // 4 % 30] + "."] * 3
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 3)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame(labels[:800], "doc_id bigint, quality int, toxic int")
    out = mixing_report(docs, known).where("doc_id >= 800").collect()
    wrong = [r["doc_id"] for r in out if (int(np.argmax(r["posterior"])) == 2) != (r["doc_id"] % 4 == 3)]
    assert len(out) == 400 and not wrong


def test_mixture_keeps_clean_documents(labelled):
    docs, labels = labelled
    out = mixed(docs, labels)
    assert out.columns == docs.columns
    copies = out.join(labels, "doc_id").groupBy("quality", "toxic").agg(F.count_distinct("doc_id").alias("n")).collect()
    found = {(r["quality"], r["toxic"]): r["n"] for r in copies}
    assert found[1, 0] == 120 and found.get((1, 1), 0) < 60 and found.get((0, 0), 0) < 60


def test_no_clean_document_is_lost_from_a_clean_table(spark):
    import random
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(2000):
        words = [rnd.choice(["stone", "river", "cloud", "green", "walk"]) for _ in range(rnd.randint(20, 100))]
        if i % 200 < 2:
            words = [w + "|" for w in words]
        elif i % 200 < 6:
            words[::10] = ["idiot"] * len(words[::10])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 200 >= 2), int(2 <= i % 200 < 6)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    clean = {i for i in range(2000) if i % 200 >= 6}
    assert len(clean) == 0.97 * len(rows)
    assert clean <= {r["doc_id"] for r in mixed(docs, known).collect()}
    report = mixing_report(docs, known).collect()
    assert min(r["rate"] for r in report if r["doc_id"] in clean) >= 1.0
    totals = sum(np.array(r["posterior"]) * r["rate"] * r["n_tokens"] for r in report)
    assert np.abs(totals / totals.sum() - [0.9, 0.055, 0.045]).max() < 0.01


def test_odd_tables(docs, none, labelled):
    _, labels = labelled
    assert mixing_report(docs, labels.limit(0)).count() == docs.count()
    assert mixing_report(none, labels).count() == 0
    rows = mixing_report(docs, labels).collect()
    assert len(rows) == docs.count() and all(r["rate"] == 1.0 for r in rows if r["n_tokens"] == 0)
