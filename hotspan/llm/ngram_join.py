"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its word shingles ("tokens", 64-bit hashes). Equal
sets are one entity. In an order that puts rare tokens first, two sets with
Jaccard similarity of at least t share at least k tokens within their first
``n - ceil(t n) + k`` ones (k of the smaller set). So:

1. One pass writes each document's entity and a count sketch of all tokens,
   which orders tokens from rare to frequent and says which are crowded.
2. A second pass emits the extended prefix of each entity. Rare tokens are
   grouped by token; those of one entity alone cannot match and go. Entities
   with fewer than k tokens left go, too.
3. The same argument on what is left gives a shorter prefix. Its rare tokens
   are index keys as they are. Its frequent tokens are not: combinations of
   two of them are, within hash classes whose number grows with the set, such
   that two similar sets share two frequent tokens of one class, or a rare one.
4. In each key's group all entities meet a few leaders of the group; verified
   links give components, so a group of copies costs its size, not its square.
5. Entities that still share a key with another component are put in one
   cluster with what they share it with. A cluster ships the whole set of each
   member once, however many keys its members share, and compares those of
   different components by exact counts; it emits the links that join
   components, fewer than its members, and no pairs. Where sets have to be
   shipped many times, they are compared in rounds, one after the other.
6. Similarities are those of the whole sets, all 64 bits of each token.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotspan.llm.components import components
from hotspan.llm.crowded import CROWDED, PART, Sketch, bucket_levels
from hotspan.llm.tables import small_batches, texts
from hotspan.llm.words import grams, groups, mix, signed, words_of
from hotspan.session import stage_table


@dataclass(frozen=True)
class JoinConfig:
    shingle: int = 5
    #: Similarity of at least this many hundredths.
    percent: int = 75
    #: k of the extended prefix, as hundredths of the set's size.
    extension: int = 10
    #: In how many orders keys choose leaders in step 4.
    leaders: int = 4
    #: Sets, and tokens of sets, of one cluster that meet in one task as a block.
    group_rows: int = 1_000
    group_tokens: int = 1_000_000
    #: Sets of the largest cluster that is compared as one; in larger ones each key is a cluster.
    cluster_rows: int = 50_000
    #: Times the tokens of all sets that one round of comparisons shuffles at most, about.
    shipped: int = 2
    #: Digests that a task remembers, so as not to emit equal sets again.
    remembered: int = 200_000

    def need(self, n: int) -> int:
        """Tokens that a set of n shares at least with a similar one: ceil(t n)."""
        return -(-self.percent * n // 100)

    def k(self, n: int) -> int:
        return min(self.need(n), max(2, self.extension * n // 100))

    def prefix(self, n: int) -> int:
        return n - self.need(n) + self.k(n)

    def least_k(self, n: int) -> int:
        """The smallest k among sets that can be similar to one of size n."""
        return self.k(self.need(n))

    def classes(self, n: int) -> int:
        """Hash classes of frequent tokens for pairs whose smaller set has the bit length of n."""
        return max(1, self.extension * (1 << (n.bit_length() - 1)) * 3 // 1000)


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words, of all of them together."""
    for _, _, data, at in groups(column):
        words = words_of(data, at, lower=True)
        whole = grams(words.hashes, shingle)
        for a, b in itertools.pairwise(words.first.tolist()):
            if b - a >= shingle:
                yield np.unique(whole[a : b - shingle + 1])
            else:
                yield grams(words.hashes[a:b], b - a, seed=b - a) if b > a else np.zeros(0, np.uint64)


def entity(tokens: np.ndarray) -> tuple[int, int]:
    """96 bits of a digest of the set, and its size in the low 31 bits of the second number."""
    digest = hashlib.blake2b(tokens.tobytes(), digest_size=12).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True) << 31 | len(tokens)


ENTITY = "e1 bigint, e2 bigint"
SIZE = (1 << 31) - 1


def _first_pass(docs: DataFrame, config: JoinConfig) -> DataFrame:
    """``doc, th, n, e1, e2`` of every document, and the parts of the token sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = Sketch(), set()
        schema = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("e1", pa.int64()), ("e2", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])
        for batch in batches:
            out = []
            for tokens in shingle_sets(batch.column(0), config.shingle):
                e = entity(tokens)
                out.append((len(tokens), *e))
                if e not in seen:
                    sketch.add(tokens)
                    if len(seen) < config.remembered:
                        seen.add(e)
            n = len(out)
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        parts = list(sketch.parts())
        none = pa.nulls(len(parts), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none] * 5 + [pa.array([b for b, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())], schema=schema)

    return docs.select("text", "doc", "th").mapInArrow(run, f"doc bigint, th bigint, n bigint, {ENTITY}, {PART}")


def _prefixes(docs: DataFrame, levels: np.ndarray, config: JoinConfig) -> DataFrame:
    """``token, e1, e2, frequent`` of the extended prefixes, rare tokens first."""
    packed, mask = zlib.compress(levels.tobytes(), 1), np.uint64(len(levels) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = np.frombuffer(zlib.decompress(packed), np.uint8), set()
        for batch in batches:
            tokens_out, e_out = [], []
            for tokens in shingle_sets(batch.column(0), config.shingle):
                n = len(tokens)
                if n < 3:  # smaller sets are similar to equal ones alone
                    continue
                e = entity(tokens)
                if e in seen:
                    continue
                if len(seen) < config.remembered:
                    seen.add(e)
                order = np.argsort(rank[(tokens & mask).astype(np.int64)], kind="stable")
                kept = tokens[order[: config.prefix(n)]]
                tokens_out.append(kept)
                e_out.append((*e, len(kept)))
            if tokens_out:
                tokens = np.concatenate(tokens_out)
                e1, e2, count = (np.array(c, np.int64) for c in zip(*e_out, strict=True))
                yield pa.RecordBatch.from_arrays([
                    pa.array(signed(tokens)), pa.array(np.repeat(e1, count)), pa.array(np.repeat(e2, count)),
                    pa.array(rank[(tokens & mask).astype(np.int64)] >= CROWDED)], ["token", "e1", "e2", "frequent"])

    return docs.select("text").mapInArrow(run, f"token bigint, {ENTITY}, frequent boolean")


def index_keys(tokens: list[tuple[bool, int, int]], n: int, config: JoinConfig) -> list[int]:
    """The keys of a set of size n, from its (frequent, count, token) triples in order."""
    least = config.least_k(n)
    levels = {n.bit_length(): config.classes(n), config.need(n).bit_length(): config.classes(config.need(n))}
    keys = set()
    for level, classes in levels.items():
        short = tokens[: len(tokens) - least + min(least, classes + 1)]
        keys.update(t for often, _, t in short if not often)
        often = np.array([t for often, _, t in short if often], np.int64).view(np.uint64)
        group = mix(often, 77) % np.uint64(classes)
        for c in np.unique(group):
            mine = np.sort(often[group == c])
            i, j = np.triu_indices(len(mine), 1)
            pairs = mix(mix(mine[i], level) + mine[j], 78)
            keys.update(signed(pairs).tolist())
    return sorted(keys)


def _survivors(prefixes: DataFrame, config: JoinConfig) -> DataFrame:
    """``e1, e2, tokens``: entities that can be similar to another, with the prefix tokens that others have, too."""
    rare = prefixes.where("not frequent")
    same = Window.partitionBy("token")
    rare = rare.withColumns({"df": F.count("*").over(same), "one": F.min("e1").over(same), "other": F.max("e1").over(same)}).where("one <> other")
    left = rare.select("token", "e1", "e2", "df", "frequent").unionByName(
        prefixes.where("frequent").select("token", "e1", "e2", F.lit(0).cast("bigint").alias("df"), "frequent"))
    # An entity has as many rows as tokens in its prefix (times the tasks that met a copy of it).
    sets = left.groupBy("e1", "e2").agg(F.sort_array(F.collect_set(F.struct("frequent", "df", "token"))).alias("tokens"))
    # A size of n needs least_k(n) tokens, which grow with n: k(need(n)), as in the configuration.
    n = F.col("e2").bitwiseAND(SIZE)
    need = lambda x: F.ceil(F.lit(config.percent) * x / 100)
    least = F.least(need(need(n)), F.greatest(F.lit(2), F.floor(F.lit(config.extension) * need(n) / 100)))
    return sets.where(F.size("tokens") >= least)


def _keys(survivors: DataFrame, config: JoinConfig) -> DataFrame:
    """``key, e1, e2``: the index entries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for e1, e2, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = index_keys([(t["frequent"], t["df"], t["token"]) for t in tokens], e2 & SIZE, config)
                rows.extend((k, e1, e2) for k in keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 3)], ["key", "e1", "e2"])

    return survivors.mapInArrow(run, f"key bigint, {ENTITY}")


def _sizes_fit(config: JoinConfig) -> Column:
    """Two sets with ``percent`` similarity have sizes that far apart at most."""
    x, y = F.col("a2").bitwiseAND(SIZE), F.col("b2").bitwiseAND(SIZE)
    return (100 * F.least(x, y)) >= (config.percent * F.greatest(x, y))


PAIR = ["a1", "a2", "b1", "b2"]
LINK = "a1 bigint, a2 bigint, b1 bigint, b2 bigint, a bigint, b bigint"
#: Stands for a missing doc_id, so that it is no component's smallest.
NO_DOC = (1 << 63) - 1


def _ordered(df: DataFrame) -> DataFrame:
    """Pairs with the smaller entity first, once each."""
    swap = F.struct("b1", "b2") < F.struct("a1", "a2")
    return df.select(*[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in zip(PAIR, ["b1", "b2", "a1", "a2"], strict=True)]).distinct()


def _open(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, e1, e2, own`` of the keys whose entities are in several components."""
    own = F.struct(F.coalesce("label.e1", "e1").alias("e1"), F.coalesce("label.e2", "e2").alias("e2")).alias("own")
    marked = keys.join(labels, ["e1", "e2"], "left").select("key", "e1", "e2", own)
    mixed = marked.groupBy("key").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select("key")
    return stage_table(marked.join(mixed, "key"), "open")


def _leader_pairs(keys: DataFrame, config: JoinConfig) -> DataFrame:
    """Every entity with the leader of each of its keys.

    Keys choose leaders in several different orders, so a large group of
    similar sets meets several leaders, and few of its members miss them all.
    """
    ways = F.lit(config.leaders)
    turn = F.struct(F.xxhash64("e1", "e2", F.pmod("key", ways), ways).alias("h"), "e1", "e2")
    leaders = keys.groupBy("key").agg(F.min(turn).alias("f"), F.count("*").alias("size")).where("size > 1")
    # Written, so that a crowded key can be split in the join.
    leaders = stage_table(leaders.select("key", F.col("f.e1").alias("a1"), F.col("f.e2").alias("a2")), "leaders")
    met = keys.withColumnsRenamed({"e1": "b1", "e2": "b2"}).join(leaders, "key").where("a1 <> b1 or a2 <> b2")
    return _ordered(met.where(_sizes_fit(config)).select(*PAIR))


def _in_rounds(
    rows: DataFrame, unit: list[str], shipped: int | None, held: int, links: Callable[[DataFrame], DataFrame], name: str, config: JoinConfig
) -> DataFrame:
    """``links`` of all ``rows``, whole units of them at a time.

    A set is shuffled once for each comparison it takes part in, which can be
    many times the sets on disk. ``shipped`` tokens are dealt out to rounds of
    at most ``config.shipped`` times the ``held`` ones, about; what a round
    shuffles goes when its links are written.
    """
    rounds = max(1, -(-(shipped or 0) // (config.shipped * max(1, held))))
    turn = F.pmod(F.xxhash64(*unit, F.lit(rounds)), F.lit(rounds))
    parts = [stage_table(links(rows.where(turn == i) if rounds > 1 else rows), name) for i in range(rounds)]
    return functools.reduce(DataFrame.unionByName, parts)


def joining_links(sets: list[np.ndarray], own: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that join components: i of ``left`` and j of ``right`` are similar.

    ``own`` names the components so far. Of the links that join the same two
    components only one is given, so there are fewer links than components.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    tokens = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    kinds, column, seen = np.unique(tokens, return_inverse=True, return_counts=True)
    often = seen[column] > 1
    row, column = row[often], np.unique(column[often], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    place = np.full(len(sets), -1)
    shared, width = np.zeros((len(left), len(right)), np.float32), int(column[-1]) + 1 if len(column) else 0
    for low in range(0, width, 2048):  # some kinds of tokens at a time, so that tables stay small
        a, b = np.searchsorted(column, [low, low + 2048])

        def table(chosen: np.ndarray) -> np.ndarray:
            place.fill(-1)
            place[chosen] = np.arange(len(chosen))
            at, column_at = place[row[a:b]], column[a:b] - low
            out = np.zeros((len(chosen), 2048), np.float32)
            out[at[at >= 0], column_at[at >= 0]] = 1
            return out

        one = table(left)
        shared += one @ (one if left is right else table(right)).T
    names, group = np.unique(own, return_inverse=True)
    links = []
    for i, counts in zip(left.tolist(), shared.astype(np.int64), strict=True):
        near = 100 * counts >= percent * (sizes[i] + sizes[right] - counts)
        near &= group[right] != group[i]
        found, first = np.unique(group[right[near]], return_index=True)
        links.extend((i, j) for j in right[near][first].tolist())
        group[np.isin(group, found)] = group[i]
    return links


def _clustered_links(open_keys: DataFrame, sets: DataFrame, held: int, config: JoinConfig) -> DataFrame:
    """Links between components that share a key, found by exact comparison in clusters.

    Entities that share keys, directly or over others, are one cluster. A
    cluster too large for that (its keys reach over many unlike sets) is cut
    into the groups of its keys, those with the same members once. A cluster
    is dealt out in blocks, and every two blocks meet in a task of their own.
    ``held`` are the tokens of all ``sets``.
    """
    first = open_keys.groupBy("key").agg(F.min(F.struct("e1", "e2")).alias("b"))
    star = open_keys.join(first, "key").select(F.struct("e1", "e2").alias("a"), "b").distinct()
    cluster = components(star).select("node.e1", "node.e2", F.xxhash64("label").alias("cluster"))
    large = stage_table(cluster.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") > config.cluster_rows), "large")
    once = cluster.join(open_keys.select("e1", "e2", "own").distinct(), ["e1", "e2"])
    if large.isEmpty():
        rows = once.select(F.col("cluster").alias("g"), "e1", "e2", "own")
    else:
        whole = once.join(large, "cluster", "left_anti").select(F.col("cluster").alias("g"), "e1", "e2", "own")
        wide = open_keys.join(cluster.join(large, "cluster", "left_semi"), ["e1", "e2"]).select("key", "e1", "e2", "own")
        members = wide.groupBy("key").agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("e1", "e2").cast("decimal(38,0)")).alias("x"),
            F.sum(F.xxhash64("e2", "e1", F.lit(1)).cast("decimal(38,0)")).alias("y"))
        by_key = wide.join(members.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "key")
        rows = whole.unionByName(by_key.select(F.col("key").alias("g"), "e1", "e2", "own"))
    rows = stage_table(rows, "clusters")
    size = F.col("e2").bitwiseAND(SIZE)
    blocks = F.greatest(F.ceil(F.count("*") / config.group_rows), F.ceil(F.sum(size) / config.group_tokens)).cast("int")
    of = stage_table(rows.groupBy("g").agg(blocks.alias("blocks"), F.sum(size).alias("tokens")), "blocks")
    # Every set meets each block of its cluster once.
    shipped = of.agg(F.sum(F.col("blocks") * F.col("tokens"))).first()[0]
    dealt = (
        rows.join(of.drop("tokens"), "g").withColumn("block", F.pmod(F.xxhash64("e1", "e2", F.lit(5)), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        .select("g", "low", "high", "block", "e1", "e2", F.xxhash64("own").alias("own"))
    )

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        block = group["block"].to_numpy()
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        if block.min() == block.max():
            right = left
            if group["low"].iloc[0] != group["high"].iloc[0]:  # the other block is empty
                left = right = left[:0]
        links = joining_links([_unpack(t) for t in group["tokens"]], group["own"].to_numpy(), left, right, config.percent)
        i, j = np.array(links, np.int64).reshape(-1, 2).T
        e, doc = group[["e1", "e2"]].to_numpy(), group["doc"].to_numpy()
        return pd.DataFrame(np.concatenate([e[i], e[j], doc[i, None], doc[j, None]], axis=1), columns=[*PAIR, "a", "b"])

    unit = ["g", "low", "high"]

    def met(part: DataFrame) -> DataFrame:
        full = part.join(sets, ["e1", "e2"]).select(*unit, "block", "e1", "e2", "own", "doc", "tokens")
        return full.groupBy(*unit).applyInPandas(meet, LINK)

    return _in_rounds(dealt, unit, shipped, held, met, "more_links", config)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _once(docs: DataFrame, config: JoinConfig) -> DataFrame:
    """``doc, th, text`` without the repeated rows that a task remembers, so that no row comes often."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            fresh = []
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fresh.append(row not in seen)
                if len(seen) < config.remembered:
                    seen.add(row)
            yield batch.filter(pa.array(fresh, pa.bool_()))

    return docs.select("doc", "th", "text").mapInArrow(run, "doc bigint, th bigint, text string")


def _sets(docs: DataFrame, wanted: DataFrame, config: JoinConfig) -> DataFrame:
    """``e1, e2, doc, tokens`` of the wanted entities, from one document of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = list(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True))
            found = [(w, t.tobytes()) for t, w in zip(shingle_sets(batch.column(0), config.shingle), want, strict=True) if entity(t) == w[:2]]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([w[i] for w, _ in found], pa.int64()) for i in range(3)), pa.array([t for _, t in found], pa.binary())],
                ["e1", "e2", "doc", "tokens"])

    # The rows are joined and then made distinct by the same columns: one shuffle of the texts.
    chosen = _once(docs, config).join(wanted, ["doc", "th"]).dropDuplicates(["doc", "th"])
    return chosen.select("text", "e1", "e2", "doc").mapInArrow(run, f"{ENTITY}, doc bigint, tokens binary")


def _verified(pairs: DataFrame, sets: DataFrame, config: JoinConfig) -> DataFrame:
    """The pairs whose sets are similar enough, as links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True):
                x, y = _unpack(a), _unpack(b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= config.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:6], [*PAIR, "a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("e1").alias("a1"), F.col("e2").alias("a2"), F.col("doc").alias("a"), F.col("tokens").alias("tokens_a"))
    right = sets.select(F.col("e1").alias("b1"), F.col("e2").alias("b2"), F.col("doc").alias("b"), F.col("tokens").alias("tokens_b"))
    full = pairs.join(left, ["a1", "a2"]).join(right, ["b1", "b2"]).select(*PAIR, "a", "b", "tokens_a", "tokens_b")
    return full.mapInArrow(run, LINK)


def _labels(links: DataFrame) -> DataFrame:
    """``e1, e2, label`` of linked entities; the label has the component's smallest doc_id first."""
    node = lambda x: F.struct(F.col(x).alias("doc"), F.col(f"{x}1").alias("e1"), F.col(f"{x}2").alias("e2"))
    found = components(links.select(node("a").alias("a"), node("b").alias("b")))
    return found.select("node.e1", "node.e2", "label")


def similarity_components(docs: DataFrame, config: JoinConfig | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id that can be reached by links, the
    own one included. Texts without words (null, empty, blank) have no
    shingles and no links. Rows that repeat are linked with each other; rows
    of one doc_id with different texts are different documents. A row without
    doc_id takes part in links but names no component; if nothing of its
    component has a doc_id, the component is null. Other columns are ignored.
    """
    config = config or JoinConfig()
    docs = texts(docs)
    small_batches(docs.sparkSession)
    docs = docs.withColumns({"doc": F.coalesce("doc_id", F.lit(NO_DOC)), "th": F.xxhash64("text")})
    first = stage_table(_first_pass(docs, config), "entities")
    entities = first.where("block is null").select("doc", "th", "n", "e1", "e2")
    levels = bucket_levels(first.where("block is not null").select("block", "counts"))
    survivors = stage_table(_survivors(_prefixes(docs, levels, config), config), "survivors")
    keys = stage_table(_keys(survivors, config), "keys")

    one = entities.where("n > 0").groupBy("e1", "e2").agg(F.min(F.struct("doc", "th")).alias("least")).select("e1", "e2", "least.*")
    sets = stage_table(_sets(docs, one.join(survivors.select("e1", "e2"), ["e1", "e2"]), config), "sets")

    size = lambda c: F.col(c).bitwiseAND(SIZE)
    held = sets.agg(F.sum(size("e2"))).first()[0] or 0
    pairs = stage_table(_leader_pairs(keys, config), "pairs")
    shipped = pairs.agg(F.sum(size("a2") + size("b2"))).first()[0]
    links = _in_rounds(pairs, PAIR, shipped, held, lambda part: _verified(part, sets, config), "links", config)
    links = links.unionByName(_clustered_links(_open(keys, _labels(links)), sets, held, config))
    named = one.join(_labels(links), ["e1", "e2"], "left").select("e1", "e2", F.coalesce("label.doc", "doc").alias("low"))
    with_id = lambda c: F.when(F.col(c) < NO_DOC, F.col(c))
    return entities.join(named, ["e1", "e2"], "left").select(
        with_id("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, with_id("low")).otherwise(with_id("doc")).alias("component_id"))


def one_of_each(docs: DataFrame, config: JoinConfig | None = None) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, each once.

    Rows without a doc_id name no group and stay. Rows of one doc_id with
    different texts are different documents.
    """
    found = similarity_components(docs, config)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")  # so that no column's name can clash
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), row)
    known = keyed.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "th"])
    return known.unionByName(keyed.where("doc_id is null")).select("row.*")
