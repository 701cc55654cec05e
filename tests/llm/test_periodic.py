import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from hotspan.llm.periodic import find_runs, planted, run_report, runs_of

SCHEMA = "doc_id bigint, text string, runs string, kept string, n_words string"


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute(words, least=24, repeats=3):
    """Every period and every start: the definition."""
    out = []
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(least, repeats * q) and not any(
                    q % p == 0 and s <= start and start + length <= s + n for s, n, p in out):
                out.append((start, length, q))
            i += 1
    return sorted(out)


def plant(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def report(doc_id, text):
    words = plant(doc_id, words_of(text))
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            digest("".join(f"{s},{n},{p}\n" for s, n, p in runs)),
            digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_equal_every_period_tried():
    rnd = random.Random(1)
    seen = 0
    for _ in range(150):
        texts = []
        for _ in range(rnd.randint(0, 4)):
            words, letters = [], rnd.choice([1, 2, 3, 50])
            for _ in range(rnd.randint(0, 6)):
                x = [rnd.randrange(letters) for _ in range(rnd.randint(0, 60))]
                if rnd.random() < 0.3 and len(x) > 4:
                    y = list(x)
                    y[rnd.randrange(len(y))] = 99
                    x = rnd.choice([x + x + y + y, x + y, x + x + y])
                words += x * rnd.randint(1, 6) + x[: rnd.randint(0, len(x))]
            texts.append(words)
        first = np.cumsum([0, *map(len, texts)])
        want = [brute(w) for w in texts]
        assert runs_of(np.array([c for w in texts for c in w], np.int64), first, 24, 3) == want
        seen += sum(map(len, want))
    assert seen > 300


def test_a_block_whose_grams_all_recur_inside_it():
    a = list(range(100)) + [1000] * 1
    b = list(range(100)) + [1001] * 1
    words = (a + a + b + b) * 4  # period 404: every short gram comes back earlier
    assert runs_of(np.array(words, np.int64), np.array([0, len(words)]), 24, 3) == [brute(words)] == [[(0, 1616, 404)]]


@pytest.mark.parametrize("words", [[0] * 400_000, list(range(100_000)) * 4, ([1] * 50 + [2]) * 6000])
def test_long_texts_take_seconds(words):
    began = time.time()
    assert runs_of(np.array(words, np.int64), np.array([0, len(words)]), 24, 3)[0]
    assert time.time() - began < 10


def test_query_rows(spark, docs, corpus):
    rnd = random.Random(8)
    base = ["w%d" % i for i in range(40)]
    more = [(1000 + i, " ".join((rnd.sample(base, rnd.randint(1, 30)) * 9)[: rnd.randint(0, 200)])) for i in range(60)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    got = run_report(find_runs(planted(table))).collect()
    small = [(r[0], r[1]) for r in corpus if len(r[1] or "") < 20_000] + more
    want = sorted((report(*r) for r in small), key=str)
    long_ids = {r[0] for r in corpus if len(r[1] or "") >= 20_000}
    assert sorted((tuple(r) for r in got if r["doc_id"] not in long_ids), key=str) == want
    assert len(got) == table.count()
    assert sum(r["n_runs"] > 0 for r in got) > 10


def test_odd_tables(spark, none):
    assert find_runs(none).count() == 0 and run_report(find_runs(planted(none))).count() == 0
    odd = spark.createDataFrame(
        [(None, None, "x", "y", "z"), (1, "", None, None, None), (2, " \n\t", "", "", ""), (3, "a " * 30, "", "", ""), (3, "a " * 30, "", "", "")], SCHEMA)
    rows = find_runs(odd).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [(r["n_words"], r["kept"], len(r["runs"])) for r in rows] == [(0, "", 0), (0, "", 0), (0, "", 0), (30, "a", 1), (30, "a", 1)]
    with pytest.raises(ValueError):
        find_runs(odd, least=10)
