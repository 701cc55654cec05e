"""SentencePiece encoding and decoding with a table of distinct chunks.

A text, with its blanks marked and one mark put in front, is cut before every
run of marks. Where no piece of the vocabulary has a mark behind another
character, no merge reaches across such a cut, so the segments of the whole
text are those of its chunks, one after the other. ``cuttable`` proves this
from the model file; a model without that property, or with a normaliser that
changes characters, has its texts encoded whole.

A task holds a table of the distinct chunks it has seen. Each new chunk is
segmented once, by the library; ids are joined back by position with one
gather per group of texts. Decoding is a gather as well, from the bytes of
all pieces.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspan.llm.tables import small_batches, texts

MARK = "▁"
_CHUNK = re.compile(" +[^ ]*")
#: Chunks, and characters of chunks, that a task's table holds before it starts anew.
REMEMBERED = 400_000
REMEMBERED_CHARS = 16 << 20
#: Characters of texts whose chunks are looked up together.
GROUP_CHARS = 1 << 20


def cuttable(model: bytes) -> bool:
    """Whether a text may be cut at its marks: proved from the model file."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    norm, trainer, kinds = proto.normalizer_spec, proto.trainer_spec, proto.SentencePiece
    pieces = [p for p in proto.pieces if p.type not in (kinds.CONTROL, kinds.UNKNOWN, kinds.BYTE)]
    return (
        trainer.model_type == trainer.BPE
        and trainer.byte_fallback  # else neighbouring unknown characters are one id
        and not trainer.treat_whitespace_as_suffix
        and not norm.precompiled_charsmap
        and norm.add_dummy_prefix
        and norm.escape_whitespaces
        and not norm.remove_extra_whitespaces
        and all(p.type == kinds.NORMAL for p in pieces)
        and any(p.piece == MARK for p in pieces)
        and not any(MARK in p.piece.lstrip(MARK) for p in pieces)
    )


def _processor(model: bytes):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=model)


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``values[start:start + size]`` of all spans, joined."""
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1]) if len(ends) else 0)
    return values[at + np.repeat(starts - (ends - sizes), sizes)]


def encoder(model: bytes, cut: bool) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """A function that gives the ids of texts: (offsets of the texts, ids)."""
    library = _processor(model)
    if not cut:
        def whole(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found = [library.encode(t) for t in batch]
            return np.cumsum([0, *map(len, found)]), np.array([i for f in found for i in f], np.int32)

        return whole

    lone = library.piece_to_id(MARK)
    table: dict[str, int] = {}
    starts, ids, chars = np.zeros(1, np.int64), np.zeros(0, np.int32), 0

    def encode(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        nonlocal starts, ids, chars
        if len(table) > REMEMBERED or chars > REMEMBERED_CHARS:
            table.clear()
            starts, ids, chars = np.zeros(1, np.int64), np.zeros(0, np.int32), 0
        cuts = [_CHUNK.findall(" " + t.replace(MARK, " ")) if t else [] for t in batch]
        chunks = [c for chunk in cuts for c in chunk]
        new = [c for c in dict.fromkeys(chunks) if c not in table]
        if new:
            # The library puts the first mark of a chunk there itself.
            found = [f if c != " " else [lone] for c, f in zip(new, library.encode([c[1:] for c in new]), strict=True)]
            table.update(zip(new, range(len(table), len(table) + len(new)), strict=True))
            starts = np.concatenate([starts, starts[-1] + np.cumsum([len(f) for f in found])])
            ids = np.concatenate([ids, np.array([i for f in found for i in f], np.int32)])
            chars += sum(map(len, new))
        place = np.fromiter(map(table.__getitem__, chunks), np.int64, len(chunks))
        sizes = starts[place + 1] - starts[place]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return upto[np.cumsum([0, *map(len, cuts)])], gather(ids, starts[place], sizes)

    return encode


def decoder(model: bytes) -> Callable[[np.ndarray, np.ndarray], list[str]]:
    """A function that gives the texts of ids: (offsets, ids) to texts."""
    library = _processor(model)
    n = library.vocab_size()
    surface, marked, silent = [], np.zeros(n, bool), np.zeros(n, bool)
    for i in range(n):
        piece = library.id_to_piece(i)
        if library.is_byte(i):
            surface.append(bytes([int(piece[3:-1], 16)]))
        elif library.is_unknown(i) or library.is_control(i):
            surface.append(library.decode([i]).encode())
            silent[i] = not surface[-1]
        else:
            surface.append(piece.replace(MARK, " ").encode())
            marked[i] = piece.startswith(MARK)
    data = np.frombuffer(b"".join(surface), np.uint8)
    sizes = np.array([len(s) for s in surface], np.int64)
    starts = np.cumsum(sizes) - sizes

    def decode(at: np.ndarray, ids: np.ndarray) -> list[str]:
        raw = gather(data, starts[ids], sizes[ids]).tobytes()
        upto = np.concatenate([[0], np.cumsum(sizes[ids])])[at]
        out = []
        for i in range(len(at) - 1):
            own = ids[at[i] : at[i + 1]]
            low = int(upto[i])
            if len(own):
                head = own[0] if not silent[own[0]] else next((x for x in own if not silent[x]), own[0])
                low += bool(marked[head])  # the mark that encoding puts in front
            try:
                out.append(raw[low : int(upto[i + 1])].decode())
            except UnicodeDecodeError:  # ids of no text: the library says how bytes are replaced
                out.append(library.decode(own.tolist()))
        return out

    return decode


def _shared(df: DataFrame, path: str):
    with open(path, "rb") as file:
        model = file.read()
    return df.sparkSession.sparkContext.broadcast((model, cuttable(model)))


def _groups(column: list) -> Iterator[list[str]]:
    group, size = [], 0
    for text in column:
        text = text or ""
        if group and size + len(text) > GROUP_CHARS:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def encode_texts(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids`` of every whole text, row by row, as the library encodes it.

    No begin or end ids. Null and empty texts have no ids. Repeated rows are
    encoded each; a null doc_id stays null; other columns are ignored. A very
    long text is a group alone, a text without blanks one chunk. No shuffle;
    the broadcast model file is bounded.
    """
    small_batches(docs.sparkSession)
    shared = _shared(docs, model_path)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*shared.value)
        for batch in batches:
            at = 0
            for group in _groups(batch.column(1).to_pylist()):
                offsets, ids = encode(group)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)).cast(pa.int64()), lists], schema=schema)
                at += len(group)

    return texts(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids, text``: the text that the library's decode gives for ``ids``.

    Null ids are no ids and give an empty text, and so do empty ones; an id
    outside the vocabulary is an error. Other columns are ignored.
    """
    small_batches(encoded.sparkSession)
    shared = _shared(encoded, model_path)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(shared.value[0])
        for batch in batches:
            lists = batch.column(1).cast(pa.list_(pa.int32()))
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            own = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), own, pa.array(decode(at, ids), pa.string())], schema=schema)

    rows = encoded.select(F.col("doc_id").cast("long"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>, text string")


def piece_report(decoded: DataFrame) -> DataFrame:
    """The rows of ``op12``: counts and digests."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))
