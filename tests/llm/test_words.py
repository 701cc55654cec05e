import random
import re

import numpy as np
import pyarrow as pa

from hotspan.llm.words import groups, words_of


def test_words_are_runs_of_other_bytes():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["a", "B", "é", "\x0b", " ", "\n", "\x1c", "日"]) for _ in range(rnd.randint(0, 12))) for _ in range(500)] + [None, ""]
    seen = {}
    for low, high, data, at in groups(pa.array(texts)):
        words = words_of(data, at, lower=True)
        for i, text in enumerate(texts[low:high]):
            own = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
            a, b = words.first[i], words.first[i + 1]
            assert [data[s:e].tobytes().decode().replace("B", "b") for s, e in zip(words.starts[a:b], words.ends[a:b], strict=True)] == own
            for word, h in zip(own, words.hashes[a:b].tolist(), strict=True):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    assert words_of(np.zeros(0, np.uint8), np.zeros(1, np.int64), False).hashes.size == 0
