import re

from hotspan.llm.substring import SubstringConfig, remove_repeats


def brute(rows, window):
    """Kept words by (doc_id, text) of rows with a doc_id."""
    seen, out = set(), {}
    for doc, text in rows:
        words = re.findall("[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out[doc, text] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


def check(frame, rows, config):
    known = sorted({(d, t) for d, t in rows if d is not None}, key=lambda r: r[0])
    want = brute(known, config.window)
    got = remove_repeats(frame, config).select("doc_id", "n_words", "n_removed", "kept", "spans").collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got if r["doc_id"] is not None) == sorted(
        (d, *want[d, t]) for d, t in rows if d is not None)
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
        assert all(s["end"] - s["start"] >= config.window for s in r["spans"])
        assert r["doc_id"] is not None or r["n_removed"] == 0


def test_equals_brute_force(docs, corpus):
    check(docs, [(r[0], r[1]) for r in corpus], SubstringConfig())


def test_short_windows_within_and_across_texts(spark):
    import random
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60)))) for i in range(80)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), rows, SubstringConfig(window=7, anchor=3))


def test_empty_table(none):
    assert remove_repeats(none).count() == 0
