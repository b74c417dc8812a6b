"""Random samples with a seed: the rows with the smallest digests, the same whatever the partitions.

A sample of a union is the sample of the parts' samples, so samples of parts can be kept and merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def place(seed: int, keys: Sequence[str]) -> Column:
    """A row's place in a random order: an MD5 digest of the seed and its keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).cast("binary"))


def sample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """``n`` random rows, in random order; ties of digests by keys. Tasks hand on ``n`` rows each."""
    return df.withColumn("_place", place(seed, keys)).orderBy("_place", *keys).limit(n).drop("_place")


def sample_by(df: DataFrame, n: int, by: Sequence[str], keys: Sequence[str], seed: int = 0) -> DataFrame:
    """``n`` random rows of each group; tasks hand on ``n`` rows a group."""
    w = Window.partitionBy(*by).orderBy("_place", *keys)
    return df.withColumn("_place", place(seed, keys)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_place", "_n")
