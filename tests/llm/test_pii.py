import itertools
import random
import re
import time

from hotspan.llm.pii import Field, base_spans, count_potentials, find_pii, label_spans, luhn, messages, nodes, skip_edges

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP, CARD = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
PARTS = ["a", "b1", "@", ".", "com", "_", "-", " ", "12", "255", "4111 1111 1111 1111", "+1 (974) 555-3436", "974", "x@y.de", "%", "(", ")", "1.2.3.4", "é", "\n", "+", "0"]


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


def test_base_equals_the_patterns():
    rnd = random.Random(2)
    for _ in range(15_000):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14)))
        assert base_spans(text) == brute(text)
    assert base_spans("9" * 200_000 + ".1.1.1 " + "a" * 100_000) == brute("9" * 10) == []


FLAT = tuple((0.0,) * 5 for _ in range(5))
STRONG = Field(FLAT, (5.0, 4.0, 4.0))


def added(text, field=STRONG):
    return [text[a:b] for _, a, b in label_spans(text, field)[1]]


def test_distant_mentions_get_one_label():
    text = "call +1 (974) 555-3436 " + "word 17 " * 50 + "or 1 974 555 3436, not 7 123 555 3400"
    assert [text[a:b] for _, a, b in label_spans(text, STRONG)[0]] == ["+1 (974) 555-3436"] and added(text) == ["1 974 555 3436"]
    assert added(text, Field(FLAT, (0.0, 0.0, 0.0))) == added(text, Field(FLAT, (2.9, 2.9, 2.9))) == []


def test_similar_mentions():
    assert added("+1 (974) 555-3436 and 974 555 3436") == ["974 555 3436"]
    assert added("+1 (974) 555-3436 and 12 1 974 555 3436 x")[0].endswith("1 974 555 3436")
    assert added("+49 30 1234567 or 0049 30 1234567.") == ["0049 30 1234567"]
    assert added("mail Anna.Lee@example.org, that is anna dot lee at example dot org.") == ["anna dot lee at example dot org"]
    assert added("anna@example.org, see anna@localhost") == ["anna@localhost"]
    assert added("+1 (974) 555-3436 and 974 555 3437, 2024-01-02, 12 300 400, meet at noon, bob@localhost") == []


def test_potentials_are_counted(spark):
    twice = "+1 (974) 555-3436 and +1 974 555 3436, 974 555 3436"
    frame = spark.createDataFrame([(i, twice) for i in range(40)], "doc_id bigint, text string")
    field = count_potentials(frame)
    assert field.skip[0] > 3 and field.skip[2] == 0
    assert count_potentials(frame.limit(0)).skip == (0.0, 0.0, 0.0)


def test_messages_equal_every_labelling():
    """Beliefs of small fields, loops included, against the best of all labellings."""
    rnd = random.Random(21)
    contents = ["9745553436", "19745553436", "5553436", "a@b.c", "a@x", "77"]
    checked = 0
    for _ in range(300):
        chain = tuple(tuple(rnd.uniform(-0.5, 0.5) for _ in range(5)) for _ in range(5))
        field = Field(chain, tuple(rnd.uniform(0, 7) for _ in range(3)))
        found = [(10 * i, 10 * i + 5, rnd.choice([0, 0, 1, 4]), rnd.choice(contents)) for i in range(rnd.randint(1, 6))]
        edges = skip_edges(found)

        def score(labels):
            own = sum((field.pattern if f[2] else field.plain) for f, k in zip(found, labels) if k == f[2])
            near = sum(chain[a][b] for a, b in zip(labels, labels[1:]))
            return own + near + sum(field.skip[kind] for a, b, kind in edges if labels[a] == labels[b])

        ranked = sorted(itertools.product(range(5), repeat=len(found)), key=score, reverse=True) if len(found) <= 5 else None
        if ranked and len(ranked) > 1 and score(ranked[0]) - score(ranked[1]) < 1.2:
            continue  # loops count some evidence twice, which can tip near ties
        if ranked:
            assert tuple(messages(field, found).tolist()) == ranked[0]
            checked += 1
    assert checked > 100


def test_long_texts_take_seconds():
    for text in ("7" + "a" * 10**6, "1 " + "(" * 10**6, "+1 974 555 3436 " + "12 " * 300_000, "a@b.cd " + "x" * 10**6 + "@", "1" * 10**6, "a at " * 200_000 + "a@b.cd"):
        began = time.time()
        label_spans(text, STRONG)
        assert time.time() - began < 8


def test_shortcut_equals_the_field(docs, corpus):
    field = count_potentials(docs)
    rnd = random.Random(8)
    for _ in range(300):
        text = " ".join(rnd.choice(PARTS) for _ in range(30))
        found = nodes(text, base_spans(text))
        if found:
            labels = messages(field, found)
            added = [(a, b) for (a, b, own, _), k in zip(found, labels.tolist(), strict=True) if k and not own]
            assert added == [(a, b) for _, a, b in label_spans(text, field)[1]]
            assert all(own in (0, k) for (_, _, own, _), k in zip(found, labels.tolist(), strict=True))


def test_rows(docs, none):
    assert find_pii(docs).count() == docs.count() and find_pii(none).count() == 0
