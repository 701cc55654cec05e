import hashlib
import zlib

import numpy as np

from hotspan.llm.media import fingerprint, from_wav, media_columns, media_digests, payload_of, to_wav


def test_media_read_back(docs, corpus, none):
    rows = media_digests(media_columns(docs)).collect()
    assert len(rows) == len(corpus)
    want = {}
    for _, text, *_ in corpus:
        data = (text or "").encode()
        padded = data + b"\0" * (64 if not data else -len(data) % 64)
        want[hashlib.sha256(padded).hexdigest()] = (len(padded), zlib.crc32(padded[-64:]))
    assert {r["payload_sha256"]: (r["payload_bytes"], r["tail_crc32"]) for r in rows} == want
    assert len({(r["media_sha256"], r["feature"]) for r in rows}) == len(want)
    assert media_digests(media_columns(none)).count() == 0


def test_fingerprint_finds_a_tone():
    tone = (128 + 100 * np.sin(2 * np.pi * 32 * np.arange(2560) / 256)).astype(np.uint8)
    times, codes = fingerprint(tone)
    assert (codes[times == 0] >> 12 & 0xFF).tolist().count(32) > 0
    assert from_wav(to_wav(tone.tobytes())) == tone.tobytes() and payload_of(None) == (0, bytes(64))


def test_short_texts_have_fingerprints_of_their_own(spark):
    texts = ["a", "one two", "One two", "stone river", "river stone", "green cloud walks " * 6, "green cloud walks " * 13]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    features = [r["feature"] for r in media_digests(media_columns(docs)).collect()]
    assert not any(f.startswith("0:") for f in features) and len(set(features)) == len(texts)


def test_every_sample_counts():
    silence = np.full(1024, 128, np.uint8)
    _, quiet = fingerprint(silence)
    for at in range(1024):
        click = silence.copy()
        click[at] = 255
        assert fingerprint(click)[1].tolist() != quiet.tolist(), at
