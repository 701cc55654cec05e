"""Quality rules: how far a document's distributions are from its language.

Two histograms of a document are compared with those of its language by the
Jensen-Shannon distance (the root of the divergence to base 2, between 0 and
1): the classes of its
characters, and its share of common words. A language's reference is the sum
over all documents of that language. Both comparisons have a minimum length,
below which they say nothing. DataFrame functions only, no shuffle of texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotspan.llm.tables import settled
from hotspan.session import stage_table

SPACE = "[\\x20\\x09-\\x0D]"

# Very common words by language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on"],
    "fr": ["le", "la", "de", "et", "les", "des", "un", "une", "en", "du", "que", "qui", "dans", "par", "pour", "au"],
    "de": ["der", "die", "und", "das", "von", "den", "zu", "mit", "ein", "eine", "im", "ist", "nicht", "des", "auf", "sich"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "una", "para", "es"],
}

# The character classes, besides white space and "any other".
CLASSES = {
    "upper": "[A-Z]",
    "digit": "[0-9]",
    "stop": "[.,;:!?'\"()-]",
    "symbol": "[#*$%&|<>=+/@_~^{}\\[\\]\\\\]",
    "wide": "[^\\x00-\\x7F]",
}


@dataclass(frozen=True)
class QualityConfig:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: The least characters and words for which a distance is judged.
    min_chars: int = 200
    min_compared_words: int = 50
    max_char_distance: float = 0.245
    max_word_distance: float = 0.308
    common_words: dict[str, list[str]] = field(default_factory=lambda: COMMON_WORDS)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def _with_repeats(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words`` of the array ``_words``: the words inside three-word
    windows that occur twice or more in it.

    Windows are told apart by 64-bit hashes. Sorted, equal ones are neighbours;
    few texts have any, so only those look for the places of their windows.
    """
    no = F.array().cast("array<bigint>")
    keyed = F.transform(
        F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get("_words", i + 1), F.get("_words", i + 2)),
    )
    df = df.withColumn("_tri", keyed).withColumn("_sorted", F.sort_array("_tri"))
    df = df.withColumn("_twice", F.array_distinct(F.filter("_sorted", lambda x, j: F.coalesce(F.get("_sorted", j + 1) == x, F.lit(False)))))

    def by_order(tri: Column) -> Column:
        s = F.sort_array(F.transform(tri, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
        same = lambda v, x, j: F.coalesce(F.get(v, j)["h"] == x["h"], F.lit(False))
        return _let(s, lambda v: F.sort_array(F.transform(
            F.filter(v, lambda x, j: F.when(j > 0, same(v, x, j - 1)).otherwise(False) | same(v, x, j + 1)), lambda x: x["i"])))

    by_lookup = F.filter(
        F.transform("_tri", lambda x, i: F.when(F.array_contains("_twice", x), i.cast("long"))), lambda i: i.isNotNull())
    df = df.withColumn("_at", F.when(F.size("_twice") == 0, no).when(F.size("_twice") <= 32, by_lookup).otherwise(by_order(F.col("_tri"))))
    steps = F.transform("_at", lambda x, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get("_at", j + 1) - x, F.lit(3).cast("long"))))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)
    return df.withColumn("n_repeat_words", total).drop("_tri", "_sorted", "_twice", "_at")


def repeat_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def char_histogram(text: Column, word_chars: Column) -> Column:
    counts = [F.char_length(text) - word_chars, *[F.regexp_count(text, F.lit(p)) for p in CLASSES.values()]]
    known = counts[0]
    for c in counts[1:]:
        known = known + c
    return F.transform(F.array(*counts, F.char_length(text) - known), lambda c: c.cast("double"))


def word_histogram(all_words: Column, lang: Column, config: QualityConfig) -> Column:
    """Counts of the language's common words, and of all other words at the end."""
    lists = F.create_map(*[x for k, v in config.common_words.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    longest = max(len(w) for v in config.common_words.values() for w in v)

    def of(common: Column) -> Column:
        short = F.filter(all_words, lambda w: F.char_length(w) <= longest)
        hits = F.filter(F.transform(short, F.lower), lambda w: F.array_contains(common, w))
        return _let(hits, lambda h: F.concat(
            F.transform(common, lambda c: F.size(F.filter(h, lambda w: w == c)).cast("double")),
            F.array((F.size(all_words) - F.size(h)).cast("double")),
        ))

    return _let(F.coalesce(lists[lang], F.array().cast("array<string>")), of)


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two histograms of equal length; 0 if one is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def of(both: Column) -> Column:
        p, q, sp, sq = both["p"], both["q"], both["sp"], both["sq"]
        cells = F.zip_with(p, q, lambda x, y: term(x / sp, (x / sp + y / sq) / 2) + term(y / sq, (x / sp + y / sq) / 2))
        # rounding can leave equal histograms a little below 0
        return F.when((sp > 0) & (sq > 0), F.sqrt(F.greatest(total(cells) / 2, F.lit(0.0)))).otherwise(0.0)

    return _let(F.struct(a.alias("p"), b.alias("q"), total(a).alias("sp"), total(b).alias("sq")), of)


def _histograms(docs: DataFrame, config: QualityConfig) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({
        "_words": words(text),
        "word_chars": F.char_length(F.regexp_replace(text, SPACE + "+", "")).cast("long"),
    }).withColumns({
        "_chars": char_histogram(text, F.col("word_chars")),
        "_common": word_histogram(F.col("_words"), F.coalesce(F.col("lang"), F.lit("")), config),
    })


def _measured(docs: DataFrame, config: QualityConfig) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    out = _with_repeats(_histograms(docs, config).withColumns({
        "n_words": F.size("_words").cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": repeat_lines(text),
        "_length": F.char_length(text),
    }))
    return out.drop("_words")


def _references(histograms: DataFrame, config: QualityConfig) -> dict[str, tuple[list[float], list[float]]]:
    """The summed histograms of each configured language; the driver gets one row for each."""
    width = {k: len(v) + 1 for k, v in config.common_words.items()}
    rows = histograms.where(F.col("lang").isin(list(width))).groupBy("lang").agg(
        F.array(*[F.sum(F.col("_chars")[i]) for i in range(len(CLASSES) + 2)]).alias("chars"),
        F.array(*[F.sum(F.get(F.col("_common"), F.lit(i))) for i in range(max(width.values()))]).alias("common"),
    ).collect()
    return {r["lang"]: (list(r["chars"]), list(r["common"])[: width[r["lang"]]]) for r in rows}


def language_references(docs: DataFrame, config: QualityConfig | None = None) -> dict[str, tuple[list[float], list[float]]]:
    """The reference histograms, over all documents of each configured language."""
    config = config or QualityConfig()
    return _references(_histograms(docs.select("text", "lang"), config), config)


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VERDICT = ["char_distance", "word_distance", "base_failed", "kept"]


def _judged(measured: DataFrame, found: dict, config: QualityConfig, keep: list[str]) -> DataFrame:
    lang = F.coalesce(F.col("lang"), F.lit(""))

    def reference(part: int) -> Column:
        none = F.array().cast("array<double>")
        if not found:
            return none
        pairs = [x for k, v in sorted(found.items()) for x in (F.lit(k), F.array(*[F.lit(float(c)) for c in v[part]]))]
        return F.coalesce(F.create_map(*pairs)[lang], none)

    out = measured.withColumns({
        "char_distance": F.when(F.col("_length") >= config.min_chars, distance(F.col("_chars"), reference(0))).otherwise(0.0),
        "word_distance": F.when(F.col("n_words") >= config.min_compared_words, distance(F.col("_common"), reference(1))).otherwise(0.0),
    }).withColumn(
        "base_failed",
        (F.col("n_words") < config.min_words) | (100 * F.col("n_repeat_words") > config.max_repeat_percent * F.col("n_words")),
    ).withColumn(
        "kept",
        settled(~F.col("base_failed")
                & (F.col("char_distance") <= config.max_char_distance)
                & (F.col("word_distance") <= config.max_word_distance)),
    )
    return out.select(*keep, *MEASURES, *VERDICT)


def quality_columns(docs: DataFrame, config: QualityConfig | None = None) -> DataFrame:
    """Add the measures and the verdict to documents with ``text`` and ``lang``.

    ``kept`` is false for a document that fails the base rules or whose
    histograms are too far from its language's. A null text is an empty one
    and fails; a document in a null language, or one without a reference, is
    judged by the base rules alone. Rows stay rows, repeated ones too. Columns
    of the added names (``MEASURES`` and ``VERDICT``) are replaced, any other
    name is the caller's. A very long text takes memory in proportion to its
    length. Texts are read twice, once for the references, and never shuffled.
    """
    config = config or QualityConfig()
    keep = [n for n in docs.columns if n not in MEASURES + VERDICT]
    # the caller's row is one column, so that no name of it can clash
    row = F.struct(*[F.col(f"`{n}`") for n in keep]).alias("row")
    inner = _measured(docs.select(row, "text", "lang"), config).drop("text")
    judged = _judged(inner, language_references(docs, config), config, ["row"])
    return judged.select(*[F.col("row").getField(n).alias(n) for n in keep], *MEASURES, *VERDICT)


def quality_report(docs: DataFrame, config: QualityConfig | None = None) -> DataFrame:
    """The same without the texts: ``doc_id``, measures and verdict.

    The measures are written once to the shared folder, so texts are read once.
    """
    config = config or QualityConfig()
    measured = _measured(docs.select("doc_id", "lang", "text"), config).drop("text")
    staged = stage_table(measured, "quality")
    return _judged(staged, _references(staged, config), config, ["doc_id"])
