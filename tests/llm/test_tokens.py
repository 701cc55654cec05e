import random

import public_tokenizers
from tokenizers import Tokenizer

from hotspan.llm.tokens import count_tokens, counter, proven_words

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_counts_equal_the_library():
    spec = open(PATH, encoding="utf-8").read()
    library = Tokenizer.from_str(spec)
    rnd = random.Random(4)
    parts = ["the", "don't", "It'S", "!!'s", "İx", "Σ", "ß", "é", "é", "日本", "12", "½", "\x1c", "\x85", " ", " ", "\n", "_", "<|endoftext|>", "<|EndOfText|>", "zzqqxx"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(3000)] + ["a" * 5000]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert counter(spec, proven_words(spec))(texts) == want


def test_the_plain_characters_split_alike():
    spec = open(PATH, encoding="utf-8").read()
    library = Tokenizer.from_str(spec)
    chars = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC]]
    texts = chars + [f"a{c}b" for c in chars] + [f"1{c}{c}" for c in chars]
    assert counter(spec, proven_words(spec))(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_rows(docs, none):
    rows = count_tokens(docs, PATH).collect()
    assert len(rows) == docs.count() and {r["n_tokens"] for r in rows if r["n_bytes"] == 0} == {0}
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in rows)
    assert count_tokens(none, PATH).count() == 0
