"""Fixed-length float vectors held in arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hotspan.functions.numeric import _col


def layer_norm(vec: Column | str, eps: float = 1e-5) -> Column:
    """Shift to mean 0 and scale to variance 1 within the vector."""
    v = F.transform(_col(vec), lambda x: x.cast("double"))
    n = F.size(v)
    sums = F.aggregate(
        v,
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
        lambda acc, x: F.struct((acc["s"] + x).alias("s"), (acc["q"] + x * x).alias("q")),
        lambda acc: F.struct(
            (acc["s"] / n).alias("mean"),
            (acc["q"] / n - (acc["s"] / n) * (acc["s"] / n)).alias("var"),
        ),
    )
    # a one-element array binds the two moments once per row
    scaled = F.transform(
        F.array(sums),
        lambda m: F.transform(
            v, lambda x: (x - m["mean"]) / F.sqrt(F.greatest(m["var"], F.lit(0.0)) + F.lit(eps))
        ),
    )
    return scaled[0]


def fuse_vectors(left: Column | str, right: Column | str, eps: float = 1e-5) -> Column:
    """Sum of two layer-normalised vectors of the same width."""
    return F.zip_with(layer_norm(left, eps), layer_norm(right, eps), lambda a, b: a + b)
