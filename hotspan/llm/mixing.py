"""Mixing sources to target weights by soft membership.

A classifier, fitted on a table of labelled documents, gives each document a
posterior over domains. A document with n tokens and posterior p, taken r
times on average, adds ``r n p`` to the domains' token totals. The rates are
the nonnegative least-squares fit of the targets, found by projected gradient
steps that start at r = 1, so documents change as little as the targets ask.
Documents of a kept domain have rates of one at least, and the targets grow
with the measured totals so that they leave room for those documents.

A step needs only the residual of the totals, one number per domain. So the
rates are never stored: each pass over the documents replays the steps so far
from the few residuals, and adds up exact integer totals, which do not depend
on the order of rows or on lost tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotspan.llm.tables import settled
from hotspan.session import stage_table

WORD = "[^\\x20\\x09-\\x0D]+"
#: One unit of posterior and rate in the integer totals.
GRAIN = 1 << 20


@dataclass(frozen=True)
class MixingConfig:
    #: Share of all tokens that each domain gets.
    targets: tuple[tuple[str, float], ...] = (("clean", 0.90), ("low", 0.055), ("toxic", 0.045))
    #: Domains that are not to shrink: documents that are most likely of one have rate 1 at least.
    keep: tuple[str, ...] = ("clean",)
    #: Tokens in all per token now; None for the least from 1 on that scales no kept domain down.
    budget: float | None = None
    #: Labelled documents that the classifier is fitted on, at most: those with the smallest hash.
    max_labelled: int = 20_000
    steps: int = 25
    tolerance: float = 1e-3
    seed: int = 7


def domain_of(quality: Column, toxic: Column) -> Column:
    """The domain of a labelled document."""
    return F.when(toxic == 1, "toxic").when(quality == 1, "clean").otherwise("low")


FEATURES = [f"_f{i}" for i in range(9)]


def _letters(text: Column) -> Column:
    """The words of a text in lower case; letters only, so that a stop behind a word does not hide it."""
    return F.split(F.lower(text), "[^\\p{L}\\p{M}]+")


def with_features(docs: DataFrame, marks: list[str]) -> DataFrame:
    """Add the features, shares that tell the domains apart, and the number of words ``_n``.

    Two steps of plain columns, so that each text is searched once for each. An empty text has zeros.
    """
    text = F.coalesce("text", F.lit(""))
    # A lookup for each word, which costs the same for any number of marks.
    hits = F.size(F.filter(_letters(text), lambda w: w.isin(marks))) if marks else F.lit(0)
    counted = {"_hits": hits, "_size": F.greatest(F.char_length(text), F.lit(1)), "_n": F.regexp_count(text, F.lit(WORD)).cast("long")}
    shares = {"[A-Z]": 10, "[|]": 50, "[#*$%&<>=]": 20, "!": 20, "\n": 50, "[0-9]": 50}
    values = [F.regexp_count(text, F.lit(k)) / F.col("_size") * v for k, v in shares.items()] + [
        F.log1p(F.col("_n").cast("double")) / 5, F.log1p(F.col("_hits").cast("double")),
        F.least(F.col("_hits") / F.greatest(F.col("_size") / 200, F.lit(1.0)), F.lit(3.0))]
    return docs.withColumns(counted).withColumns({f: v.cast("double") for f, v in zip(FEATURES, values, strict=True)})


def toxic_marks(labelled: DataFrame) -> list[str]:
    """All words that are far more frequent in labelled toxic documents than in the others.

    Counted over the bounded labelled table. Each is in 2 % of the toxic documents at
    least, so the driver gets 50 times a document's mean number of distinct words at most.
    """
    toxic = labelled.agg(F.sum("toxic")).first()[0] or 0
    words = labelled.select("toxic", F.explode(F.array_distinct(_letters(F.coalesce("text", F.lit(""))))).alias("word"))
    counts = words.where("length(word) >= 3").groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all"))
    ranked = counts.where(F.col("bad") >= max(3, 0.02 * toxic)).where("bad >= 0.8 * all").orderBy(F.desc("bad"), "word")
    return [r["word"] for r in ranked.collect()]


@dataclass
class Classifier:
    domains: list[str]
    weights: np.ndarray  # domains x features
    intercepts: np.ndarray
    marks: list[str]

    def posterior(self, df: DataFrame, name: str) -> DataFrame:
        """Add the probability of each domain to a table with the features."""
        def score(d: int) -> Column:
            total = F.lit(float(self.intercepts[d]))
            for w, f in zip(self.weights[d], FEATURES, strict=True):
                total = total + float(w) * F.col(f)
            return total

        powers = df.withColumn(name, F.array(*[score(d) for d in range(len(self.domains))])).withColumn("_top", F.array_max(name))
        powers = powers.withColumn(name, F.transform(name, lambda x: F.exp(x - F.col("_top"))))
        powers = powers.withColumn("_top", F.aggregate(name, F.lit(0.0), lambda a, b: a + b))
        return powers.withColumn(name, F.transform(name, lambda x: x / F.col("_top")))


def fit_classifier(docs: DataFrame, labels: DataFrame, config: MixingConfig) -> Classifier:
    """A logistic regression on at most ``max_labelled`` labelled documents."""
    chosen = labels.where("doc_id is not null and quality is not null and toxic is not null").select("doc_id", "quality", "toxic").orderBy(
        F.xxhash64("doc_id", F.lit(config.seed)), "doc_id").limit(config.max_labelled)
    table = stage_table(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("domain", domain_of(F.col("quality"), F.col("toxic"))), "labelled")
    marks = toxic_marks(table)
    domains = [d for d, _ in config.targets]
    index = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")).cast("double") - 1
    rows = with_features(table, marks).select(index.alias("label"), *FEATURES).where("label >= 0")
    present = sorted(int(r["label"]) for r in rows.select("label").distinct().collect())
    weights, intercepts = np.zeros((len(domains), len(FEATURES))), np.full(len(domains), -30.0)
    if len(present) > 1:
        assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
        model = LogisticRegression(family="multinomial", maxIter=25, regParam=1e-4).fit(assembled)
        found, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
        for d in present:
            weights[d], intercepts[d] = found[d], bias[d]
    elif present:
        intercepts[present[0]] = 0.0
    else:  # no labels: all domains alike
        intercepts[:] = 0.0
    return Classifier(domains, weights, intercepts, marks)


def _rate(steps: list[list[float]], least: Column) -> Column:
    """The rate of a document with posterior ``p`` (an array) after the given steps, ``least`` or more."""
    rate = F.lit(1.0)
    if not steps:
        return rate
    given = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    return F.aggregate(given, rate, lambda r, s: F.greatest(
        least, r + F.aggregate(F.zip_with(s, F.col("p"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)))


def _sums(members: DataFrame, values: list[Column]) -> list[float]:
    """Exact sums, whatever the order of the rows."""
    row = members.agg(*[F.sum(F.round(v * GRAIN).cast("decimal(38,0)")).alias(f"s{i}") for i, v in enumerate(values)]).first()
    return [float(x or 0) / GRAIN for x in row]


def fit_rates(members: DataFrame, targets: np.ndarray, config: MixingConfig) -> list[list[float]]:
    """The steps of the projected gradient method; ``members`` has ``n`` and ``p``, and
    the least rate ``least`` if it is not zero for all.

    Distances between totals are measured by the inverse of the Gram matrix
    ``sum n p p'``. In that metric the gradient's largest slope is one, so
    full steps never overshoot, and without rates at their least one step is enough.
    """
    count, steps = len(targets), []
    scale = max(float(targets.sum()), 1.0)
    cells = [(i, j) for i in range(count) for j in range(i, count)]
    gram = np.zeros((count, count))
    for (i, j), value in zip(cells, _sums(members, [F.col("n") * F.col("p")[i] * F.col("p")[j] for i, j in cells]), strict=True):
        gram[i, j] = gram[j, i] = value
    inverse = np.linalg.pinv(gram, rcond=1e-9)
    least = F.col("least") if "least" in members.columns else F.lit(0.0)
    for _ in range(config.steps):
        rated = members.withColumn("r", _rate(steps, least))
        gap = targets - np.array(_sums(rated, [F.col("r") * F.col("n") * F.col("p")[d] for d in range(count)]))
        if float(np.abs(gap).sum()) <= config.tolerance * scale:
            break
        steps.append([float(f"{x:.12g}") for x in inverse @ gap])
    return steps


ADDED = ["n_tokens", "posterior", "rate", "copies"]


def _members(docs: DataFrame, model: Classifier, keep: list[str], config: MixingConfig) -> DataFrame:
    found = model.posterior(with_features(docs, model.marks), "p")
    return found.select(
        *keep, F.col("_n").alias("n"),
        # Posteriors are cut to a grain, so the same document has the same value in every pass.
        F.transform("p", lambda x: F.round(x, 6)).alias("p"),
        F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.coalesce("text", F.lit(""))).alias("_hash")).withColumn("least", _least(config))


def _least(config: MixingConfig) -> Column:
    """1 for a document that is most likely of a kept domain, otherwise 0."""
    kept = [i for i, (d, _) in enumerate(config.targets, 1) if d in config.keep]
    return F.when(F.array_position("p", F.array_max("p")).isin(kept), 1.0).otherwise(0.0) if kept else F.lit(0.0)


def targets_of(totals: np.ndarray, now: float, config: MixingConfig) -> np.ndarray:
    """The tokens that each domain is to have, from the totals by posterior and the tokens now."""
    shares = np.array([w for _, w in config.targets])
    shares = shares / shares.sum()
    budget = config.budget
    if budget is None:
        kept = [i for i, (d, w) in enumerate(config.targets) if d in config.keep and w > 0]
        budget = max([1.0, *(totals[i] / shares[i] / now for i in kept)]) if now else 1.0
    return shares * now * budget


def _steps(members: DataFrame, config: MixingConfig) -> list[list[float]]:
    now, *totals = _sums(members, [F.col("n"), *[F.col("n") * F.col("p")[d] for d in range(len(config.targets))]])
    return fit_rates(members, targets_of(np.array(totals), now, config), config)


def _rated(members: DataFrame, steps: list[list[float]], keep: list[str], config: MixingConfig) -> DataFrame:
    unit = F.pmod(F.xxhash64("_hash", F.lit(config.seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return members.withColumn("rate", F.when(F.col("n") == 0, 1.0).otherwise(F.round(_rate(steps, F.col("least")), 6))).select(
        *keep, F.col("n").alias("n_tokens"), F.col("p").alias("posterior"), "rate", settled(F.floor(F.col("rate") + unit).cast("int")).alias("copies"))


def mixing_report(docs: DataFrame, labels: DataFrame, config: MixingConfig | None = None) -> DataFrame:
    """``doc_id, n_tokens, posterior, rate, copies`` of every row; the texts are read once.

    ``copies`` is the rate rounded up or down by a hash of the row, so that
    its mean is the rate and a rerun gives the same. Null and empty texts have
    no tokens and rate 1; a null doc_id stays null. Repeated rows get equal
    copies. Without labels, or with labels of one domain only, all documents
    have the same posterior. Other columns are ignored.
    """
    config = config or MixingConfig()
    docs = docs.select("doc_id", "text")
    members = stage_table(_members(docs, fit_classifier(docs, labels, config), ["doc_id"], config), "members")
    return _rated(members, _steps(members, config), ["doc_id"], config)


def mixed(docs: DataFrame, labels: DataFrame, config: MixingConfig | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its ``copies`` say; the texts are read twice."""
    config = config or MixingConfig()
    model = fit_classifier(docs, labels, config)
    members = stage_table(_members(docs.select("doc_id", "text"), model, [], config), "members")
    keep = docs.columns
    inner = [f"_{i}" for i in range(len(keep))]  # the columns' own names may clash with the added ones
    held = docs.select("doc_id", "text", F.struct(*[F.col(c).alias(i) for c, i in zip(keep, inner, strict=True)]).alias("_row"))
    rated = _rated(_members(held, model, ["_row"], config), _steps(members, config), ["_row"], config)
    return rated.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(
        *[F.col(f"_row.{i}").alias(c) for c, i in zip(keep, inner, strict=True)])
