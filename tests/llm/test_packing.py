import random
import time

from pyspark.sql import functions as F

from hotspan.llm.ngram_join import similarity_components
from hotspan.llm.packing import Bins, PackingConfig, pack


def brute(items, capacity):
    """Best fit by looking at every bin."""
    left, marks, out = [], [], []
    for size, source, cluster in items:
        fits = [(left[b], b) for b in range(len(left)) if left[b] >= size and left[b] > 0 and source not in marks[b][0] and cluster not in marks[b][1]]
        b = min(fits)[1] if fits else len(left)
        if not fits:
            left.append(capacity)
            marks.append((set(), set()))
        left[b] -= size
        marks[b][0].add(source)
        marks[b][1].add(cluster)
        out.append(b)
    return out


def test_search_equals_brute_force():
    rnd = random.Random(13)
    for _ in range(100):
        items = [(rnd.randint(0, 50), rnd.randrange(5), rnd.randrange(20)) for _ in range(120)]
        bins = Bins(60)
        assert [bins.place(s, 1 << a, 1 << c) for s, a, c in items] == brute(items, 60)


def test_search_equals_brute_force_for_equal_items():
    rnd = random.Random(14)
    for _ in range(60):
        kinds = [(rnd.randint(0, 30), rnd.randrange(3), rnd.randrange(4)) for _ in range(12)]
        items = [k for k in kinds for _ in range(rnd.randint(1, 12))]
        bins = Bins(60)
        assert [bins.place(s, 1 << a, 1 << c) for s, a, c in items] == brute(items, 60)


def test_equal_rows_are_spread(spark):
    rows = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("s").alias("source"))
    began = time.time()
    packed = pack(rows, PackingConfig(shard_rows=1000)).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("bin").alias("bins")).collect()
    assert len(packed) == 10 and max(r["n"] for r in packed) < 1300 and all(r["n"] == r["bins"] for r in packed)
    assert time.time() - began < 60
    bins = Bins(100)
    began = time.time()
    assert [bins.place(1, 1, 1) for _ in range(20_000)] == list(range(20_000))
    assert time.time() - began < 5


def test_near_copies_by_a_cluster_column(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:i], "edit", *base[i + 1 :]]), f"s{i}") for i in range(20)] + [(100 + i, f"x{i} " * 40, f"t{i}") for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = similarity_components(frame).select("doc_id", "component_id")
    packed = pack(frame.join(found, "doc_id"), PackingConfig(capacity=512), "component_id").collect()
    bins = {}
    for r in packed:
        bins.setdefault(r["bin"], []).append(r["cluster"])
    assert len(packed) == 40 and all(len(set(c)) == len(c) for c in bins.values()) and len(bins) >= 20
    assert {r["cluster"] for r in packed if r["doc_id"] < 100} == {0}


def test_bins_hold_everything_without_conflict(docs, corpus, none):
    config = PackingConfig(capacity=128, shard_rows=40)
    rows = pack(docs, config).collect()
    words = lambda t: len((t or "").split())
    assert sum(r["n_tokens"] for r in rows) == sum(words(r[1]) for r in corpus)
    assert {r["doc_id"] for r in rows} == {r[0] for r in corpus}
    bins = {}
    for r in rows:
        bins.setdefault((r["shard"], r["bin"]), []).append(r)
    for inside in bins.values():
        assert sum(r["n_tokens"] for r in inside) <= 128
        assert len({r["source"] for r in inside}) == len({r["cluster"] for r in inside}) == len(inside)
        assert sorted(r["slot"] for r in inside) == list(range(len(inside)))
    pieces = {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["cluster"]), []).append((r["first_token"], r["n_tokens"]))
    for own in pieces.values():
        assert {a for a, _ in own} == set(range(0, max(1, max(a + n for a, n in own)), 128))
    assert pack(none).count() == 0
