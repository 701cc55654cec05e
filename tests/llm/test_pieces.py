import hashlib
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from hotspan.llm import pieces
from hotspan.llm.pieces import cuttable, decode_ids, decoder, encode_texts, encoder, piece_report

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["the", "the ", " ", "  ", "\n", "\t", "é", "é", "日本語", "　", "\xa0", "\x00", "▁", "▁▁", "12", "<s>", "</s>",
         "<unk>", "<0x41>", "Σ", "ﬁ", "😀", "a", "tion", "�", " ", "​", "\x85", "́", "x" * 20]


def model():
    with open(PATH, "rb") as file:
        return file.read()


def mixed(n, seed=2):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def test_ids_and_texts_equal_the_library(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 500)  # the table starts anew many times
    library, encode, decode = SentencePieceProcessor(model_file=PATH), encoder(model(), True), decoder(model())
    texts = mixed(6000) + ["x" * 100_000, " " * 3000, "word " * 20_000, ""]
    for low in range(0, len(texts), 300):
        part = texts[low : low + 300]
        at, ids = encode(part)
        want = [library.encode(t) for t in part]
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(part))] == want
        assert decode(at, ids) == [library.decode(e) for e in want]


def test_any_ids_decode_as_the_library_does():
    library, decode, rnd = SentencePieceProcessor(model_file=PATH), decoder(model()), random.Random(3)
    rows = [[rnd.choice([0, 1, 2, 3, 35, 200, 259, 28705, rnd.randrange(32000)]) for _ in range(rnd.randint(0, 6))] for _ in range(5000)]
    at = np.cumsum([0, *map(len, rows)])
    assert decode(at, np.array([i for r in rows for i in r])) == [library.decode(r) for r in rows]


def test_models_that_must_not_be_cut():
    assert cuttable(model())
    for change in ("piece", "suffix", "prefix", "fallback"):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model())
        if change == "piece":
            proto.pieces[1000].piece = "of▁the"
        proto.trainer_spec.treat_whitespace_as_suffix |= change == "suffix"
        proto.normalizer_spec.add_dummy_prefix &= change != "prefix"
        proto.trainer_spec.byte_fallback &= change != "fallback"
        assert not cuttable(proto.SerializeToString())
    texts = mixed(200, 5)
    (a, x), (b, y) = encoder(model(), False)(texts), encoder(model(), True)(texts)
    assert a.tolist() == b.tolist() and x.tolist() == y.tolist()


def test_query_rows(docs, corpus):
    library = SentencePieceProcessor(model_file=PATH)

    def row(doc_id, text):
        ids = library.encode(text or "")
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        return doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))

    got = piece_report(decode_ids(encode_texts(docs, PATH), PATH)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((row(r[0], r[1]) for r in corpus), key=str)


def test_odd_tables(spark, none):
    assert decode_ids(encode_texts(none, PATH), PATH).count() == 0
    odd = spark.createDataFrame([(None, None, [1], 5), (1, "", [2], 6), (1, " ", None, None)], "doc_id bigint, text string, ids array<int>, n_tokens int")
    rows = encode_texts(odd, PATH).orderBy(F.col("doc_id").asc_nulls_first(), F.size("ids")).collect()
    assert [(r["doc_id"], len(r["ids"])) for r in rows] == [(None, 0), (1, 0), (1, 1)]
    back = decode_ids(spark.createDataFrame([(None, None), (1, [])], "doc_id bigint, ids array<int>"), PATH).collect()
    assert [(r["ids"], r["text"]) for r in back] == [([], ""), ([], "")]
