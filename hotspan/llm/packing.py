"""Best-fit packing under conflicts.

Documents are packed into bins of a fixed number of tokens. Two documents of
one source, or of one cluster of duplicates, never share a bin: each bin
carries a bitmap of its sources and one of its clusters. Documents are taken
by falling size; bins stand in the order of what is left in them, and the
search goes from the tightest one that fits to its successors until one has no
conflict. If none has, a new bin is opened. So there is no cap on bins, and no
document is left out.

A document longer than a bin is cut into full bins and a rest, and only the
rest is packed. Pieces are dealt to shards of a bounded number of rows by a hash of
their row number; a shard is packed alone, so the work spreads whatever the
sources, the ids and the texts are.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspan.session import stage_table

BLANKS = "[\\x20\\x09-\\x0D]+"
PACKED = "shard int, bin int, slot int, doc_id bigint, piece int, first_token bigint, n_tokens bigint, source string, cluster bigint"


@dataclass(frozen=True)
class PackingConfig:
    capacity: int = 2048
    #: Rows that a shard holds on average; shards grow in number with the table.
    shard_rows: int = 4_000
    seed: int = 11


class Bins:
    """Open bins in the order of (tokens left, number)."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.order, self.marks, self.count = capacity, [], {}, 0
        #: The last item, and the bin behind which a search for an equal one begins.
        self.last, self.behind = None, None

    def place(self, size: int, source: int, cluster: int) -> int:
        """The bin of the tightest fit without conflict; a new one if there is none."""
        # An equal item has found all bins before the last one's in conflict, and the last one is by now.
        same = self.last == (size, source, cluster)
        at = bisect.bisect_right(self.order, self.behind) if same else bisect.bisect_left(self.order, (size, -1))
        while at < len(self.order):
            left, number = self.order[at]
            sources, clusters = self.marks[number]
            if not (sources & source or clusters & cluster):
                del self.order[at]
                break
            at += 1
        else:
            left, number, sources, clusters = self.capacity, self.count, 0, 0
            self.count += 1
        self.last, self.behind = (size, source, cluster), (left, number)
        if left > size:
            bisect.insort(self.order, (left - size, number))
            self.marks[number] = sources | source, clusters | cluster
        else:
            self.marks.pop(number, None)
        return number


def pack_shard(rows: pd.DataFrame, capacity: int) -> list[tuple[int, int]]:
    """Bin and slot of each row (``n_tokens`` at most ``capacity``, ``source``, ``cluster``) in the given order."""
    bins, slots, out = Bins(capacity), {}, []
    bit_of_source: dict[object, int] = {}
    bit_of_cluster: dict[object, int] = {}
    for size, source, cluster in zip(rows["n_tokens"].tolist(), rows["source"].tolist(), rows["cluster"].tolist(), strict=True):
        number = bins.place(
            size,
            1 << bit_of_source.setdefault(source, len(bit_of_source)),
            1 << bit_of_cluster.setdefault(cluster, len(bit_of_cluster)),
        )
        slots[number] = slots.get(number, -1) + 1
        out.append((number, slots[number]))
    return out


def pack(docs: DataFrame, config: PackingConfig | None = None, cluster: str | None = None) -> DataFrame:
    """One row for each piece of a document: its bin (``shard, bin``), its slot there and its tokens.

    Tokens are words. ``cluster`` names a column of whole numbers, such as the
    component of similar documents; rows of one cluster never share a bin.
    Without it a document's cluster is the hash of its words in lower case, so
    that exact copies are kept apart and near copies are not; a null cluster
    counts as such a hash, too. Null and empty texts are pieces of no tokens;
    a null source is a source of its own kind; repeated rows are packed each,
    in different bins. A null doc_id stays null. A very long text is cut into
    full bins. Other columns are ignored.
    """
    config = config or PackingConfig()
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    own = F.xxhash64(F.lower(F.array_join(words, " ")))
    items = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.size(words).cast("long").alias("total"), (F.coalesce(F.col(cluster).cast("long"), own) if cluster else own).alias("cluster"))
    pieces = items.withColumn("piece", F.explode(F.sequence(
        F.lit(0), F.greatest(F.ceil(F.col("total") / config.capacity).cast("int") - 1, F.lit(0)))))
    pieces = stage_table(pieces.withColumns({
        "first_token": F.col("piece") * F.lit(config.capacity).cast("long"),
        "n_tokens": F.least(F.lit(config.capacity).cast("long"), F.col("total") - F.col("piece") * config.capacity),
        # Written with the pieces: equal rows have numbers of their own, and keep them.
        "row": F.monotonically_increasing_id(),
    }).drop("total"), "pieces")
    shards = max(1, -(-pieces.count() // config.shard_rows))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "cluster", "piece", "doc_id", "source"], ascending=[False, True, True, True, True], kind="stable")
        placed = pack_shard(rows, config.capacity)
        return rows.assign(bin=[b for b, _ in placed], slot=[s for _, s in placed])

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(config.seed)), F.lit(shards)).cast("int")).drop("row")
    return dealt.groupBy("shard").applyInPandas(run, PACKED)
