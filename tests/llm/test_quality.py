import re
from collections import Counter

from hotspan.llm.quality import MEASURES, quality_columns, quality_report


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(three)
    again = {j for i, t in enumerate(three) if count[t] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def test_measures_equal_brute_force(spark, docs, corpus, none):
    rows = quality_columns(docs.withColumnRenamed("n_chars", "n_words")).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        assert tuple(r[m] for m in MEASURES) == brute(r["text"])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert quality_columns(none).count() == quality_report(none).count() == 0


def test_many_repeats_take_the_sorted_way(spark):
    text = " ".join(f"w{i % 70}" for i in range(400)) + "\n" + " ".join(f"v{i}" for i in range(300))
    row = quality_report(spark.createDataFrame([(1, text, "en")], "doc_id bigint, text string, lang string")).first()
    assert tuple(row[m] for m in MEASURES) == brute(text)


def test_junk_differs_from_its_language(spark):
    import random
    rnd = random.Random(1)
    clean = [" ".join(rnd.choice(["the", "of", "and", "to", "cat", "dog", "tree", "house", "runs", "stone", f"w{rnd.randrange(999)}x"]) for _ in range(120)) for _ in range(40)]
    junk = " ".join(f"{rnd.choice('abcdef')}{i}###" for i in range(120))
    loud = " ".join(f"WORD{chr(65 + i % 26)}{chr(65 + i // 26)}!!" for i in range(120))
    rows = quality_report(spark.createDataFrame([(i, t, "en") for i, t in enumerate([*clean, junk, loud])], "doc_id bigint, text string, lang string")).collect()
    assert {r["doc_id"] for r in rows if not r["kept"]} == {40, 41}


def test_any_other_column_stays(spark):
    rows = [(1, "a b " * 60, "en", "x", 7, 8.5, [1]), (None, None, None, None, None, None, None), (2, "", "xx", "", 0, 0.0, [])]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, _words string, _length int, row double, _chars array<int>")
    out = quality_columns(frame)
    assert out.columns == [*frame.columns, *MEASURES, "char_distance", "word_distance", "base_failed", "kept"]
    assert sorted(map(tuple, out.select(frame.columns).collect()), key=str) == sorted(rows, key=str)
    assert [r["n_words"] for r in out.orderBy(out.n_words.desc()).collect()] == [120, 0, 0]
