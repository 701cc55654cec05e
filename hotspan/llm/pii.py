"""Personal data: patterns, made consistent by a skip-chain random field.

Patterns find e-mail addresses, IP addresses, card and phone numbers. They,
the other numbers, words with an ``@`` and addresses written in words are the
nodes of one field per document. Neighbours in the text are joined by chain
potentials. Nodes are joined by skip potentials, however far apart, where they
have the same content (digits without their separators, or letters without
case), the same last digits, or the same name before the ``@``. Of a longer
run of numbers the part that ends in the digits of a known number is a node.
Loopy max-product message passing then gives a node that no pattern accepts,
such as a phone number written without its plus sign, the label that its other
mentions have.

All potentials are counted on all documents: a kind of skip edge weighs the
logarithm of how much more often it joins patterns' spans of one kind than of
two. Patterns' own spans stay. Nodes are found in time linear in the text.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspan.llm.tables import map_rows, texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The look-behind only spares starts inside a run of digits, which fail like the run's start.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RUN = re.compile(r"[0-9().\x20-]+")
_DIGITS = re.compile(r"[0-9]+")
_AT = re.compile(r"(?i)(?<=[\x20\x09-\x0D])(?:at|\(at\)|\[at\])(?=[\x20\x09-\x0D])")
_DOTS = frozenset({"dot", "(dot)", "[dot]"})
_ANY = re.compile(r"[0-9@]")
#: Kinds of skip edges.
SAME, TAIL, NAME = range(3)
#: Last digits that two mentions of one number share.
TAIL_DIGITS = 7
#: Digits that a mention may have before those of a known number: an international prefix.
PREFIX_DIGITS = 4
#: Words that an address written in words may have on each side.
ADDRESS_WORDS = 9


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in time linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern matches that pass their check, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def content(text: str) -> str:
    """What two mentions of the same thing have in common."""
    digits = re.sub("[^0-9]", "", text)
    return text.lower() if "@" in text or len(digits) < 9 else digits


def tail(text: str) -> str:
    """The last digits of a number that is long enough to be told by them, else nothing."""
    digits = re.sub("[^0-9]", "", text)
    return digits[-TAIL_DIGITS:] if "@" not in text and len(digits) >= TAIL_DIGITS else ""


def numbers(text: str, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Runs of digits and the signs between them, from a digit or bracket to a digit."""
    for m in _RUN.finditer(text, low, high):
        run = m[0]
        first = min((i for i in (run.find("("), next((d.start() for d in _DIGITS.finditer(run)), -1)) if i >= 0), default=-1)
        last = len(run.rstrip("(). -"))
        if 0 <= first < last - 1:
            yield m.start() + first, m.start() + last


def known_parts(text: str, start: int, end: int, ends: frozenset[str]) -> list[tuple[int, int]]:
    """The parts of a run of numbers that end in the last digits of known numbers.

    A part consists of whole groups of digits: the groups that hold the known
    digits, and one before them if it is short, an international prefix.
    """
    groups = [(m.start(), m.end()) for m in _DIGITS.finditer(text, start, end)]
    out, free, size, first = [], 0, 0, 0
    held: list[str] = []
    for i, (a, b) in enumerate(groups):
        held.append(text[a:b])
        size += b - a
        while size - (groups[first][1] - groups[first][0]) >= TAIL_DIGITS:
            size -= groups[first][1] - groups[first][0]
            first += 1
        if size >= TAIL_DIGITS and first >= free and "".join(held[first:])[-TAIL_DIGITS:] in ends:
            low, digits = first, size
            while low > free and digits + groups[low - 1][1] - groups[low - 1][0] <= 10 + PREFIX_DIGITS and groups[low][0] - groups[low - 1][1] <= 2:
                low -= 1
                digits += groups[low][1] - groups[low][0]
            out.append((low, i))
            free = i + 1
    return [(groups[a][0], groups[b][1]) for a, b in out]


def spelled_addresses(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, address) of addresses written in words, as in ``anna at example dot org``."""
    for m in _AT.finditer(text):
        left = list(_WORD.finditer(text, max(0, m.start() - 200), m.start()))[-ADDRESS_WORDS:]
        right = list(itertools.islice(_WORD.finditer(text, m.end(), m.end() + 200), ADDRESS_WORDS))
        if not left or not right:
            continue
        low, high = len(left) - 1, 0
        while low >= 2 and left[low - 1][0].lower() in _DOTS:
            low -= 2
        while high + 2 < len(right) and right[high + 1][0].lower() in _DOTS:
            high += 2
        last = right[high][0].rstrip(".,;:!?)]}\"'")
        name = ".".join(w[0] for w in left[low::2])
        host = ".".join([w[0] for w in right[:high:2]] + [last])
        yield left[low].start(), right[high].start() + len(last), f"{name}@{host}".lower()


def nodes(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, int, str]]:
    """(start, end, label of a pattern or 0, content) in the order of the text."""
    out = [(a, b, LABELS.index(k), content(text[a:b])) for k, a, b in base]
    known = frozenset(key for _, _, _, key in out)
    ends = frozenset(t for k, a, b in base if k != "email" and (t := tail(text[a:b])))
    free, at = [], 0
    for a, b in sorted((a, b) for _, a, b in base):
        if a > at:
            free.append((at, a))
        at = max(at, b)
    free.append((at, len(text)))
    more: list[tuple[int, int, str]] = []
    if any("@" in key for key in known):
        more += [x for x in spelled_addresses(text) if x[2] in known]
    for low, high in free:
        for a, b in numbers(text, low, high):
            parts = known_parts(text, a, b, ends) if ends else []
            more += [(x, y, content(text[x:y])) for x, y in parts or [(a, b)]]
        if text.find("@", low, high) >= 0:
            for m in _WORD.finditer(text, low, high):
                word = m[0].rstrip(".,;:!?)]}\"'")
                if "@" in word:
                    more.append((m.start(), m.start() + len(word), content(word)))
    taken, i, reach = sorted((a, b) for _, a, b in base), 0, -1
    for a, b, key in sorted(more):
        while i < len(taken) and taken[i][0] < b:
            reach, i = max(reach, taken[i][1]), i + 1
        if a >= reach:
            out.append((a, b, 0, key))
            reach = max(reach, b)
    return sorted(out)


def skip_edges(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int]]:
    """(earlier, later, kind): each mention is joined to the one before it and to the first of its content, tail or name.

    Two nodes have one edge at most, that of the closest kind.
    """
    last: dict[tuple[int, str], tuple[int, int]] = {}
    edges: dict[tuple[int, int], int] = {}
    for i, (_, _, _, key) in enumerate(found):
        name = key.partition("@")[0] if "@" in key else ""
        for kind, mark in ((SAME, key), (TAIL, tail(key)), (NAME, name)):
            if not mark:
                continue
            first, before = last.get((kind, mark), (i, i))
            for j in {first, before} - {i}:
                edges.setdefault((j, i), kind)
            last[kind, mark] = first, i
    return sorted((a, b, kind) for (a, b), kind in edges.items())


@dataclass(frozen=True)
class Field:
    """Log potentials: by pattern, between neighbours, and for equal labels across each kind of skip edge."""

    chain: tuple[tuple[float, ...], ...]
    skip: tuple[float, float, float]
    pattern: float = 9.0
    plain: float = 3.0


def messages(field: Field, found: list[tuple[int, int, int, str]], rounds: int = 20) -> np.ndarray:
    """Labels of the nodes by loopy max-product message passing."""
    n, k = len(found), len(LABELS)
    unary = np.zeros((n, k))
    for i, (_, _, label, _) in enumerate(found):
        unary[i, label] = field.pattern if label else field.plain
    chain, skips = np.array(field.chain), skip_edges(found)
    tails = np.array([*range(n - 1), *range(1, n), *(a for a, _, _ in skips), *(b for _, b, _ in skips)], int)
    heads = np.array([*range(1, n), *range(n - 1), *(b for _, b, _ in skips), *(a for a, _, _ in skips)], int)
    back = np.concatenate([np.arange(n - 1) + n - 1, np.arange(n - 1), 2 * (n - 1) + len(skips) + np.arange(len(skips)), 2 * (n - 1) + np.arange(len(skips))]).astype(int)
    weights = np.array([field.skip[kind] for _, _, kind in skips] * 2, float)
    pair = np.concatenate([np.repeat(chain[None], n - 1, 0), np.repeat(chain.T[None], n - 1, 0), weights[:, None, None] * np.eye(k)[None]])
    sent = np.zeros((len(tails), k))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, heads, sent)
        new = (pair + (belief[tails] - sent[back])[:, :, None]).max(axis=1)
        new -= new.max(axis=1, keepdims=True)
        moved = np.abs(new - sent).max(initial=0.0)
        sent = (sent + new) / 2
        if moved < 1e-6:
            break
    belief = unary.copy()
    np.add.at(belief, heads, sent)
    return belief.argmax(axis=1)


def count_potentials(docs: DataFrame) -> Field:
    """Chain and skip potentials from the label pairs of all documents.

    A chain potential is the lift of two labels as neighbours, so weak that
    neighbours alone never outweigh what a plain word has for "none". A skip
    potential compares edges between two patterns' spans: one kind for both,
    or two. An edge to a node that no pattern accepts says nothing of labels
    and is not counted. Without counts a skip potential is 0, so a corpus that
    never repeats a mention adds no spans. The driver receives one row for
    each kind and pair of labels, at most 100.
    """
    def make():
        def rows(batch):
            counts: dict[tuple[int, int, int], int] = {}
            for text in batch["text"]:
                if not text or not _ANY.search(text):
                    continue
                found = nodes(text, base_spans(text))
                pairs = [(-1, i, i + 1) for i in range(len(found) - 1)] + [(kind, a, b) for a, b, kind in skip_edges(found)]
                for kind, i, j in pairs:
                    key = kind, found[i][2], found[j][2]
                    counts[key] = counts.get(key, 0) + 1
            return {"kind": [k for k, _, _ in counts], "a": [a for _, a, _ in counts], "b": [b for _, _, b in counts], "n": list(counts.values())}

        return rows

    rows = map_rows(texts(docs), "kind int, a int, b int, n bigint", make).groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    chain, agree, differ = np.ones((len(LABELS), len(LABELS))), [1, 1, 1], [1, 1, 1]
    for r in rows:
        if r["kind"] < 0:
            chain[r["a"], r["b"]] += r["n"]
        elif r["a"] and r["b"]:
            (agree if r["a"] == r["b"] else differ)[r["kind"]] += r["n"]
    share = chain / chain.sum()
    lift = np.log(share / (share.sum(1, keepdims=True) * share.sum(0, keepdims=True)))
    weights = np.clip(lift / 4, -0.5, 0.5)
    return Field(tuple(map(tuple, weights.tolist())), tuple(float(np.log(a / d)) for a, d in zip(agree, differ, strict=True)))


def label_spans(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The patterns' spans and those that the field adds."""
    if not _ANY.search(text):
        return [], []
    base = base_spans(text)
    found = nodes(text, base) if base else []
    if not any(bool(found[a][2]) != bool(found[b][2]) for a, b, _ in skip_edges(found)):
        return base, []  # nothing can tip a plain word: chain potentials alone are below its own
    labels = messages(field, found)
    added = [(LABELS[k], a, b) for (a, b, own, _), k in zip(found, labels.tolist(), strict=True) if k and not own]
    return base, added


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``doc_id, kinds, starts, ends, is_base``: spans by kind as listed, then start.

    Offsets are code points, ends exclusive. One row per input row; a null or
    empty text has empty lists, a null doc_id stays null, other columns are
    ignored. No shuffle of texts.
    """
    field = field or count_potentials(docs)

    def make():
        def rows(batch):
            out = {"doc_id": batch["doc_id"], "kinds": [], "starts": [], "ends": [], "is_base": []}
            for text in batch["text"]:
                base, added = label_spans(text or "", field)
                spans = sorted([(*s, True) for s in base] + [(*s, False) for s in added], key=lambda s: (KINDS.index(s[0]), s[1]))
                for name, column in zip(("kinds", "starts", "ends", "is_base"), zip(*spans, strict=True) if spans else [()] * 4, strict=True):
                    out[name].append(list(column))
            return out

        return rows

    return map_rows(texts(docs), "doc_id bigint, kinds array<string>, starts array<int>, ends array<int>, is_base array<boolean>", make)
