"""Token counts with a shortcut for whole tokens.

Most words of ordinary text are tokens of the vocabulary. Which vocabulary
strings encode alone as exactly one token is proved once, with the library
itself, on the driver; the table is bounded by the vocabulary. A task then
splits a text by the tokenizer's own pattern, counts the proven words by
lookup, and leaves only the other words to the library's merges, once for
each distinct word of a batch.

The split is repeated here only for texts whose characters are all in
``PLAIN``; any other text goes to the library as a whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspan.llm.tables import map_rows, texts

#: Characters for which the own split was compared with the library's, one by one.
PLAIN = regex.compile("[\\x00-ɏ‐-‧€]*")
#: Words kept with their counts in a task, beside the proven ones.
REMEMBERED = 400_000
#: Texts whose words are looked up together.
GROUP = 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def proven_words(tokenizer_json: str) -> list[str]:
    """Vocabulary strings that the library encodes, alone, as one token."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    spec = json.loads(tokenizer_json)
    end, letters = spec["model"].get("end_of_word_suffix") or "", byte_letters()
    words = []
    for piece in spec["model"]["vocab"]:
        if piece.endswith(end):
            try:
                words.append(bytes(letters[c] for c in piece[: len(piece) - len(end)]).decode())
            except (KeyError, UnicodeDecodeError):
                continue
    found = Tokenizer.from_str(tokenizer_json).encode_batch(words, add_special_tokens=False)
    return [w for w, e in zip(words, found, strict=True) if len(e.ids) == 1]


def split_pattern(tokenizer_json: str) -> tuple[regex.Pattern, list[str]]:
    """The tokenizer's word pattern and its added tokens."""
    spec = json.loads(tokenizer_json)
    split = next(s["pattern"]["Regex"] for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split")
    return regex.compile(split.replace("\\s", "\\p{White_Space}")), [t["content"] for t in spec["added_tokens"]]


def counter(tokenizer_json: str, proven: list[str]) -> Callable[[list[str]], list[int]]:
    """A function that counts the tokens of texts."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(tokenizer_json)
    pattern, added = split_pattern(tokenizer_json)
    marks = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
    known = dict.fromkeys(proven, 1)

    def words_of(text: str) -> tuple[list[str], int]:
        parts = marks.split(text) if marks else [text]
        # The library lowers each character by itself, so sigma has one small form.
        return [w for p in parts for w in pattern.findall(p.replace("Σ", "σ").lower())], len(parts) - 1

    def count(batch: list[str]) -> list[int]:
        nonlocal known
        out: list[int] = []
        for at in range(0, len(batch), GROUP):
            split = [words_of(t) if PLAIN.fullmatch(t) else None for t in batch[at : at + GROUP]]
            if len(known) > len(proven) + REMEMBERED:
                known = dict.fromkeys(proven, 1)
            rest = list({w for s in split if s for w in s[0] if w not in known})
            known.update(zip(rest, (len(e.ids) for e in library.encode_batch(rest, add_special_tokens=False)), strict=True))
            for text, s in zip(batch[at : at + GROUP], split, strict=True):
                out.append(sum(map(known.__getitem__, s[0])) + s[1] if s else len(library.encode(text, add_special_tokens=False).ids))
        return out

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text, row by row.

    Null and empty texts have no tokens. Repeated rows are counted each;
    a null doc_id stays null; other columns are ignored. No shuffle.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = file.read()
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((spec, proven_words(spec)))

    def make():
        count = counter(*shared.value)

        def rows(batch):
            contents = [t or "" for t in batch["text"]]
            return {"doc_id": batch["doc_id"], "n_bytes": [len(t.encode()) for t in contents], "n_tokens": count(contents)}

        return rows

    counted = map_rows(texts(docs), "doc_id bigint, n_bytes bigint, n_tokens bigint", make)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
