import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from hotspan.llm.resampling import BUCKETS, bucket_counts, line_features, resample

PARTS = ["the", "THE ", " ", "\n", "\n\n", "a" * 70, "b" * 64, "c" * 65, "é", "日本語", "x-y", "9", "_", "\x85", "Z", "don't\n",
         "line one here\n", "line one here\n"]


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return words, [zlib.crc32(f.encode()) % BUCKETS for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def brute(rows, targets, percent=25):
    own = [features(t) for _, t in rows]
    s = Counter(b for _, f in own for b in f)
    t = Counter(b for x in targets for b in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + BUCKETS) / ((s[b] + 1) * (n_t + BUCKETS)))) for b in range(BUCKETS)]
    out = []
    for (doc_id, _), (words, found) in zip(rows, own):
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_features_of_lines():
    rnd = random.Random(5)
    for _ in range(300):
        texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 15))) for _ in range(rnd.randint(1, 9))]
        lines, inside, (text, code), text_across, across = line_features(pa.array(texts, pa.string()))
        often = np.bincount(code, minlength=len(lines.first) - 1)
        total = np.bincount(inside[1], often[inside[0]], BUCKETS) + np.bincount(across, minlength=BUCKETS)
        assert {b: int(n) for b, n in enumerate(total) if n} == Counter(b for t in texts for b in features(t)[1])
        size = np.bincount(text, np.bincount(inside[0], minlength=len(lines.first) - 1)[code], len(texts))
        assert (size + np.bincount(text_across, minlength=len(texts))).tolist() == [len(features(t)[1]) for t in texts]


def test_rows(spark, docs, corpus):
    targets = [corpus[i][1] for i in range(30, 40)] + [None, ""]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "item_id bigint, text string")
    got = rows_of(resample(docs, target))
    assert got == brute([(r[0], r[1]) for r in corpus], targets)
    ranks = [r[4] for r in got if r[4] is not None]
    assert sorted(ranks) == list(range(1, len(ranks) + 1)) and len(ranks) > 20


def test_many_parts_and_equal_rows(spark):
    rnd = random.Random(9)
    rows = [(i // 3, " ".join(rnd.choice(["one", "two", "three", "four\n"]) for _ in range(rnd.randint(15, 30)))) for i in range(300)]
    rows += [(7, rows[40][1])] * 200
    target = spark.createDataFrame([("one one two",)], "text string")
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(13)
    assert rows_of(resample(table, target)) == brute(rows, ["one one two"])


def test_odd_tables(spark, none, docs):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert resample(none, empty).count() == 0 and bucket_counts(empty).count() == 0
    assert resample(docs, empty).count() == docs.count()
    odd = spark.createDataFrame([(None, None, 1, 2, "x"), (None, "a " * 25, 1, 2, "x")], "doc_id bigint, text string, n bigint, score bigint, rank string")
    assert sorted(r["n_features"] for r in resample(odd, odd).collect()) == [0, 49]
    assert [r["rank"] for r in resample(odd, odd, percent=100).where("n_features > 0").collect()] == [1]
