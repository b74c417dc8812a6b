"""Bit codes of vectors in built-in functions: a scan of codes by Hamming distance, and an exact ranking of its first rows.

A code has ``bits`` bits a dimension, one for each threshold that the component exceeds, so Hamming distances add up
differences of levels. Thresholds come from means and deviations of all rows. A search reads keys and codes only
(8 bytes for 64 bits, where vectors take 4 a dimension), and fetches vectors of the nearest ``candidates`` codes.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedlake.operators.knn import top_k

#: Codes whose vectors are compared exactly, unless more are asked for.
CANDIDATES = 200
#: Decimals of thresholds.
DIGITS = 6


def thresholds(store: DataFrame, vector_col: str = "embedding", bits: int = 1) -> list[list[float]]:
    """For each dimension ``bits`` thresholds that split a normal distribution of its mean and deviation evenly."""
    z = [NormalDist().inv_cdf((k + 1) / (bits + 1)) for k in range(bits)]
    each = store.select(F.posexplode(vector_col).alias("pos", "x")).groupBy("pos")
    x = F.col("x").cast("double")
    rows = each.agg(*[F.round(F.avg(x) + F.stddev_pop(x) * v, DIGITS).alias(f"t{k}") for k, v in enumerate(z)]).orderBy("pos").collect()  # a row a dimension
    return [[float(v) for v in r[1:]] for r in rows]


def _words(flags: Column, n: int) -> Column:
    """64 flags a number."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(-(-n // 64) - 1)),
        lambda w: F.aggregate(F.slice(flags, w * 64 + 1, F.lit(64)), F.lit(0).cast("bigint"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("bigint"))),
    )


def code(vector: Column | str, cuts: Sequence[Sequence[float]]) -> Column:
    """The code of a vector, as an array of numbers; null for a null vector or one of another length."""
    v = F.col(vector) if isinstance(vector, str) else vector
    levels = F.array(*[F.array(*[F.lit(float(t)) for t in own]) for own in cuts])
    flags = F.flatten(F.zip_with(v.cast("array<double>"), levels, lambda x, own: F.transform(own, lambda t: x > t)))
    return F.when(F.size(v) == len(cuts), _words(flags, len(cuts) * len(cuts[0]) if cuts else 0))


def code_of(query: Sequence[float], cuts: Sequence[Sequence[float]]) -> list[int]:
    """The same for one vector on the driver."""
    flags = [float(x) > float(t) for x, own in zip(query, cuts, strict=True) for t in own]
    out = []
    for at in range(0, len(flags), 64):
        word = 0
        for b in flags[at : at + 64]:
            word = word << 1 | b
        out.append(word - (1 << 64) if word >> 63 else word)
    return out


def hamming(code_col: str, query: Sequence[int]) -> Column:
    """Bits that differ."""
    return sum((F.bit_count(F.get(F.col(code_col), F.lit(k)).bitwiseXOR(F.lit(w))) for k, w in enumerate(query[1:], 1)), F.bit_count(F.get(F.col(code_col), F.lit(0)).bitwiseXOR(F.lit(query[0]))))


def search(
    store: DataFrame, query: Sequence[float], cuts: Sequence[Sequence[float]], k: int, keys: Sequence[str], vector_col: str = "embedding", code_col: str = "code",
    metric: str = "vector_cosine_ops", candidates: int = CANDIDATES,
) -> DataFrame:
    """The ``k`` nearest of the ``candidates`` rows with the nearest codes (ties by key), with their exact ``distance``."""
    near = store.where(F.col(code_col).isNotNull()).select(*keys, hamming(code_col, code_of(query, cuts)).alias("_bits")).orderBy("_bits", *keys).limit(candidates)
    return top_k(store.join(F.broadcast(near.select(*keys)), list(keys), "left_semi"), query, k, keys, vector_col, metric)
