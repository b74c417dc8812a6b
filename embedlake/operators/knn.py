"""Exact nearest neighbours: one query, many queries, thresholds, exclusions, reranking and evaluation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embedlake.functions import vector as V

#: Bytes of query vectors that are sent to every task at once. More queries are joined in blocks: a task gets so
#: many bytes of queries and of rows.
QUERY_BYTES = 32 << 20


def top_k(
    store: DataFrame, query: Sequence[float], k: int, keys: Sequence[str], vector_col: str = "embedding", metric: str = "vector_cosine_ops",
    where: Column | str | None = None, max_distance: float | None = None, exclude: DataFrame | Sequence | None = None,
) -> DataFrame:
    """The ``k`` rows nearest to ``query`` with ``distance``; ties by ``keys``.

    Filters are applied before the ranking, so the result is exact. ``exclude``: values of the first key, or
    a DataFrame with the key columns.
    """
    if where is not None:
        store = store.where(where)
    if isinstance(exclude, DataFrame):
        store = store.join(exclude.select(*keys).distinct(), list(keys), "left_anti")
    elif exclude is not None and len(exclude):
        store = store.where(~F.col(keys[0]).isin(list(exclude)))
    found = store.withColumn("distance", V.DISTANCES[metric](vector_col, query)).where("distance is not null")
    if max_distance is not None:
        found = found.where(F.col("distance") <= max_distance)
    return found.orderBy("distance", *keys).limit(k)


def _distances(q, x, metric: str):
    """Distances of all queries to all rows; infinite where there is none."""
    import numpy as np

    if metric == "vector_cosine_ops":
        with np.errstate(all="ignore"):
            d = 1 - (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :])
    elif metric == "vector_ip_ops":
        d = -(q @ x.T)
    else:
        each = (np.abs(v - x) for v in q)
        d = np.stack([a.sum(axis=1) if metric == "vector_l1_ops" else np.sqrt((a * a).sum(axis=1)) for a in each])
    return np.where(np.isnan(d), np.inf, d)


def _best(best: list[list], qids, q, tags, ids, x, own_tags, k: int, metric: str, skip_same: bool) -> None:
    """Bring each query's ``k`` nearest so far up to date with some rows."""
    import numpy as np

    for at in range(0, len(ids), 8192):
        part = slice(at, at + 8192)
        for first in range(0, len(qids), 1024):
            d = _distances(q[first : first + 1024], x[part], metric)
            if tags is not None:
                d = np.where(tags[first : first + 1024, None] == own_tags[part][None, :], d, np.inf)
            for i, row in enumerate(d, first):
                if skip_same:
                    row = np.where(ids[part] == qids[i], np.inf, row)
                near = np.lexsort((ids[part], row))[:k] if len(row) <= 4 * k else _nearest(row, ids[part], k)
                best[i] = sorted(best[i] + [(float(row[j]), ids[part][j]) for j in near if np.isfinite(row[j])])[:k]


def batch_top_k(
    store: DataFrame, queries: DataFrame, k: int, key: str, query_key: str, vector_col: str = "embedding", query_vector: str = "embedding",
    metric: str = "vector_cosine_ops", match: str | None = None, skip_same: bool = False, query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """(query key, key, distance, rank): for each query the ``k`` nearest rows of ``store``; ties by key.

    Queries of at most ``query_bytes`` go to every task, and make one pass over the store in which a task keeps
    its own best ``k`` a query. More of them are dealt into blocks, the store into slices, and a task compares a
    block with a slice; no query passes through the driver. Either way what moves is k rows a query and task.
    ``match`` names a column that has to be equal on both sides; ``skip_same`` leaves out the row with the query's own key.
    """
    import numpy as np
    import pandas as pd

    columns = [query_key, query_vector, *([match] if match else [])]
    qk, sk = queries.schema[query_key].dataType.simpleString(), store.schema[key].dataType.simpleString()
    asked = queries.select(*columns).where(F.col(query_vector).isNotNull())
    held = asked.agg(F.sum(8 * F.size(query_vector) + 64), F.max(F.size(query_vector))).first()
    schema = f"_q {qk}, _k {sk}, distance double"

    def matrix(column) -> np.ndarray:
        return np.stack(column.to_numpy()).astype(float)

    def rows(qids, best: list[list]) -> pd.DataFrame:
        return pd.DataFrame([(qids[i], j, d) for i, b in enumerate(best) for d, j in b], columns=["_q", "_k", "distance"])

    if not held[0]:
        found = store.sparkSession.createDataFrame([], schema)
    elif held[0] <= query_bytes:
        block = [tuple(r) for r in asked.collect()]  # bounded by ``query_bytes``
        qids, q = [r[0] for r in block], np.array([r[1] for r in block], float)
        tags = np.array([r[2] for r in block]) if match else None

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: list[list] = [[] for _ in qids]
            for pdf in batches:
                pdf = pdf[pdf[vector_col].notna()]
                if len(pdf):
                    _best(best, qids, q, tags, pdf[key].to_numpy(), matrix(pdf[vector_col]), pdf[match].to_numpy() if match else None, k, metric, skip_same)
            yield rows(qids, best)

        found = store.select(key, vector_col, *([match] if match else [])).mapInPandas(scan, schema)
    else:
        live = store.where(F.col(vector_col).isNotNull())
        size = 8 * held[1] + 64
        blocks = -(-held[0] // query_bytes)
        slices = max(1, -(-live.count() * size // max(query_bytes, size)))
        tag = lambda df: F.col(match).alias("_m") if match else F.lit(0).alias("_m")
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
        left = asked.select(F.col(query_key).alias("_q"), F.col(query_vector).alias("_v"), tag(asked), deal(query_key, blocks).alias("_b"), every(slices).alias("_s"))
        right = live.select(F.col(key).alias("_k"), F.col(vector_col).alias("_v"), tag(live), deal(key, slices).alias("_s"), every(blocks).alias("_b"))

        def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return rows([], [])
            best: list[list] = [[] for _ in range(len(a))]
            tags, own = (a["_m"].to_numpy(), b["_m"].to_numpy()) if match else (None, None)
            _best(best, a["_q"].tolist(), matrix(a["_v"]), tags, b["_k"].to_numpy(), matrix(b["_v"]), own, k, metric, skip_same)
            return rows(a["_q"].tolist(), best)

        found = left.groupBy("_b", "_s").cogroup(right.groupBy("_b", "_s")).applyInPandas(tile, schema)
    rank = F.row_number().over(Window.partitionBy("_q").orderBy("distance", "_k"))
    out = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select(F.col("_q").alias(query_key if query_key != key else f"query_{query_key}"), F.col("_k").alias(key), "distance", "rank")


def _nearest(row, ids, k: int):
    """The ``k`` smallest by (distance, id): all that tie with the k-th are looked at."""
    import numpy as np

    edge = np.partition(row, k - 1)[k - 1]
    near = np.flatnonzero(row <= edge)
    return near[np.lexsort((ids[near], row[near]))[:k]]


def rerank(hits: DataFrame, score: Column, top_n: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``hits`` by falling ``relevance_score``; the first ``top_n`` if asked for."""
    out = hits.withColumn("relevance_score", score).orderBy(F.desc("relevance_score"), *keys)
    return out if top_n is None else out.limit(top_n)


def hit_rate(results: DataFrame, truth: DataFrame, query_key: str, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of queries whose true row is among their results, overall or ``by`` columns of ``truth``."""
    found = results.select(query_key, *keys).distinct().withColumn("_hit", F.lit(1.0))
    joined = truth.join(found, [query_key, *keys], "left")
    return joined.groupBy(*by).agg(F.avg(F.coalesce("_hit", F.lit(0.0))).alias("hit_rate"), F.count("*").alias("n_queries"))
