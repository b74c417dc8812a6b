"""Change capture: what differs between two snapshots, the latest change a key, and the retry rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_RETRIES, RETRY_MINUTES = 6, 3
PENDING_CAP, PENDING_MANY = 10_000, 9223372036854775807


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str], ignore: Sequence[str] = ()) -> DataFrame:
    """The keys with ``op``: insert, update, delete or same. Columns in ``ignore`` (embeddings) don't count."""
    cols = [c for c in new.columns if c not in keys and c not in ignore]
    a = old.select(*keys, F.struct(F.lit(1).alias("_"), *cols).alias("_old"))
    b = new.select(*keys, F.struct(F.lit(1).alias("_"), *cols).alias("_new"))
    op = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("update")
    return a.join(b, list(keys), "full_outer").select(*keys, op.alias("op"))


def state_of(rows: DataFrame, keys: Sequence[str], ignore: Sequence[str] = ()) -> DataFrame:
    """The keys with two hashes of the row (128 bits), which stand for it in later comparisons."""
    cols = [c for c in rows.columns if c not in keys and c not in ignore]
    kinds = dict(rows.dtypes)
    each = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kinds[c] else F.col(f"`{c}`") for c in cols]
    parts = [*each, *[F.col(f"`{c}`").isNull() for c in cols]] or [F.lit(0)]  # hashes pass over nulls
    return rows.select(*keys, F.xxhash64(*parts).alias("_h1"), F.xxhash64(F.lit("again"), *parts).alias("_h2"))


def diff_state(state: DataFrame, rows: DataFrame, keys: Sequence[str], ignore: Sequence[str] = ()) -> DataFrame:
    """(keys, op, _h1, _h2): as ``diff``, against the hashes that ``state_of`` gave."""
    a = state.select(*keys, F.struct("_h1", "_h2").alias("_old"))
    b = state_of(rows, keys, ignore).select(*keys, F.struct("_h1", "_h2").alias("_new"))
    op = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.col("_old") == F.col("_new"), "same").otherwise("update")
    return a.join(b, list(keys), "full_outer").select(*keys, op.alias("op"), F.col("_new._h1").alias("_h1"), F.col("_new._h2").alias("_h2"))


def latest(changes: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last change of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) if isinstance(o, str) else o for o in order])
    return changes.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def claim(queue: DataFrame, keys: Sequence[str], now: Column | None = None, limit: int | None = None) -> DataFrame:
    """Each waiting key once with its most retries, of those whose time has come."""
    due = F.col("loading_retry_after").isNull() | (F.col("loading_retry_after") < (now if now is not None else F.current_timestamp()))
    out = queue.where(due).groupBy(*keys).agg(F.max("loading_retries").alias("loading_retries"))
    return out if limit is None else out.orderBy(*keys).limit(limit)


def settle(failed: DataFrame, keys: Sequence[str], max_retries: int = MAX_RETRIES, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(requeued, dead letters) of rows that failed to load, by their ``loading_retries`` so far."""
    n, t = F.col("loading_retries"), now if now is not None else F.current_timestamp()
    wait = F.make_dt_interval(F.lit(0), F.lit(0), RETRY_MINUTES * (n + 1))
    again = failed.where(n < max_retries).select(*keys, (n + 1).alias("loading_retries"), (t + wait).alias("loading_retry_after"))
    return again, failed.where(n >= max_retries).select(*keys, F.lit("loading").alias("failure_step"))


def pending(queue: DataFrame, exact: bool = False) -> int:
    """Waiting rows; without ``exact`` a count above the cap is given as the largest number."""
    n = queue.count() if exact else queue.limit(PENDING_CAP + 1).count()
    return n if exact or n <= PENDING_CAP else PENDING_MANY
