"""The registered queries of this subpackage, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspan.llm import oracles
from hotspan.llm.chat import format_chats, read_back
from hotspan.llm.media import media_columns, media_digests
from hotspan.llm.mixing import MixingConfig, mixing_report
from hotspan.llm.ngram_join import similarity_components
from hotspan.llm.packing import pack
from hotspan.llm.periodic import find_runs, planted, run_report
from hotspan.llm.pieces import decode_ids, encode_texts, piece_report
from hotspan.llm.pii import KINDS, find_pii
from hotspan.llm.quality import quality_report
from hotspan.llm.resampling import resample
from hotspan.llm.secrets import BASE, scan_secrets
from hotspan.llm.substring import remove_repeats
from hotspan.llm.tables import read
from hotspan.llm.tokens import count_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op1_chat_formatting": oracles.CHAT,
    "op2_substring_dedup": oracles.SUBSTRING,
    "op5_quality_rules": oracles.quality(),
    "op8_ngram_jaccard_join": oracles.JACCARD,
}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id bigint, turn bigint, role string, text string")
    turns = read(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text")
    return read_back(format_chats(turns.unionByName(extra)))


@query
def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_report(read(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))


@query
def op6_media_columns(spark: SparkSession, sf: str) -> DataFrame:
    return media_digests(media_columns(read(spark, sf, "documents")))


def _spans(keep=None):
    """``kind:start:end`` of the spans for which ``keep(span)`` holds, comma-joined."""
    zipped = F.arrays_zip("kinds", "starts", "ends", *(["is_base"] if keep == "is_base" else []))
    if keep == "is_base":
        zipped = F.filter(zipped, lambda s: s["is_base"])
    elif keep:
        zipped = F.filter(zipped, lambda s: s["kinds"].isin(*keep))
    return F.array_join(F.transform(zipped, lambda s: F.concat_ws(":", s["kinds"], s["starts"], s["ends"])), ",")


def _count(kind: str, base: bool = False):
    spans = F.arrays_zip("kinds", "is_base") if base else F.arrays_zip("kinds")
    return F.size(F.filter(spans, lambda s: (s["kinds"] == kind) & (s["is_base"] if base else F.lit(True)))).cast("long")


@query
def op4_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    base = [r.kind for r in BASE]
    return scan_secrets(read(spark, sf, "documents")).select(
        "doc_id", *[_count(k).alias(f"n_{k}") for k in base],
        F.sha2(_spans(base), 256).alias("base_sha256"), _spans().alias("spans"))


@query
def op10_pii(spark: SparkSession, sf: str) -> DataFrame:
    return find_pii(read(spark, sf, "documents")).select(
        "doc_id", *[_count(k, base=True).alias(f"n_{k}") for k in KINDS],
        F.sha2(_spans("is_base"), 256).alias("base_sha256"), _spans().alias("spans"))


@query
def op8_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return similarity_components(read(spark, sf, "documents"))


@query
def op2_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeats(read(spark, sf, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_mixing(spark: SparkSession, sf: str) -> DataFrame:
    domains = [d for d, _ in MixingConfig().targets]
    return mixing_report(read(spark, sf, "documents"), read(spark, sf, "labels")).select(
        "doc_id", "n_tokens", *[F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(domains)], "rate", "copies")


@query
def op9_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(read(spark, sf, "documents"))


@query
def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return run_report(find_runs(planted(read(spark, sf, "documents"))))


@query
def op12_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_report(decode_ids(encode_texts(read(spark, sf, "documents"), model), model))


@query
def op13_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resample(read(spark, sf, "documents"), read(spark, sf, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")
