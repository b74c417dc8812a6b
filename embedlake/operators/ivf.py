"""Partition-pruned approximate search: vectors stored by the cell of their nearest centroid."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from embedlake.operators.knn import QUERY_BYTES, _distances, top_k

#: Rows that centroids are fitted on, at most, and bytes of them; every row is indexed.
SAMPLE, SAMPLE_BYTES = 100_000, 64 << 20
#: Bytes of distances that are worked out at once.
WORK_BYTES = 8 << 20
MAX_CELLS = 4096
#: Probes are chosen at the build so that this share of the nearest rows of sampled queries is found.
RECALL, ASKED, NEAREST = 0.97, 256, 10


def _kmeans(x, k: int, rounds: int = 8):
    import numpy as np

    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = _assign(x, c)
        for j in range(k):
            own = x[at == j]
            if len(own):
                c[j] = own.mean(axis=0)
    return c


def _assign(x, c):
    """The nearest centroid of each row, in blocks of bounded size."""
    import numpy as np

    own, out, step = (c * c).sum(axis=1), np.empty(len(x), np.int64), max(1, WORK_BYTES // (8 * len(c)))
    for k in range(0, len(x), step):
        out[k : k + step] = np.argmin(own - 2 * x[k : k + step] @ c.T, axis=1)
    return out


def _unit(x):
    import numpy as np

    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _probes(x, centroids, cosine: bool) -> int:
    """The fewest cells that hold ``RECALL`` of the ``NEAREST`` other rows of up to ``ASKED`` sampled rows."""
    import numpy as np

    x = _unit(x) if cosine else x
    at, need = _assign(x, centroids), []
    q = x[np.random.default_rng(11).permutation(len(x))[:ASKED]]
    c2, x2 = (centroids * centroids).sum(axis=1), (x * x).sum(axis=1)
    for v in q:
        d = x2 - 2 * (x @ v)
        near = np.argsort(d, kind="stable")[1 : NEAREST + 1]
        rank = np.argsort(np.argsort(c2 - 2 * (centroids @ v), kind="stable"))
        need += list(rank[at[near]] + 1)
    return int(np.sort(need)[int(math.ceil(RECALL * len(need))) - 1]) if need else len(centroids)


def build(store: DataFrame, path: str, vector_col: str = "embedding", cells: int | None = None, metric: str = "vector_cosine_ops", sample: int = SAMPLE) -> dict:
    """Write ``store`` to ``path`` by cell. Centroids come from a bounded sample; all rows are assigned."""
    import numpy as np

    live = store.where(F.col(vector_col).isNotNull())
    n = live.count()
    cells = max(1, min(cells or int(math.sqrt(n)), MAX_CELLS, n or 1))
    one = live.select(F.size(vector_col)).first()
    most = min(sample, max(1, SAMPLE_BYTES // (8 * max(1, one[0])))) if one else 1
    column = live.select(vector_col).orderBy(F.xxhash64(vector_col)).limit(most).toArrow().column(0).combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((1, 1))
    cosine = metric == "vector_cosine_ops"
    centroids = _kmeans(_unit(x) if cosine else x.copy(), min(cells, len(x)))
    at = store.columns.index(vector_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            v = batch.column(at)
            m = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, centroids.shape[1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_assign(_unit(m) if cosine else m, centroids).astype("int32"))], [*batch.schema.names, "cell"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in store.schema) + ", cell int"
    celled = live.mapInArrow(run, schema)
    celled.repartition(max(1, min(cells, 1 + n // 50_000)), "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    meta = {"metric": metric, "rows": n, "cells": len(centroids), "probes": _probes(x, centroids, cosine), "centroids": [[float(v) for v in c] for c in centroids]}
    store.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return meta


def search(spark: SparkSession, path: str, query: Sequence[float], k: int, keys: Sequence[str], probes: int | None = None, vector_col: str = "embedding", **more) -> DataFrame:
    """The nearest rows in the ``probes`` cells nearest to ``query`` (the index's own number if none is given); only their files are read."""
    import numpy as np

    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    q = np.array([query], float)
    c = np.array(meta["centroids"])
    d = (c * c).sum(axis=1) - 2 * ((_unit(q) if meta["metric"] == "vector_cosine_ops" else q) @ c.T)[0]
    near = [int(j) for j in np.argsort(d, kind="stable")[: probes or meta["probes"]]]
    cells = spark.read.parquet(f"{path}/cells").where(F.col("cell").isin(near))
    return top_k(cells, query, k, keys, vector_col, meta["metric"], **more)


def _cell_best(q, x, ids, k: int, metric: str) -> list[list]:
    """For each query (distance, id) of its ``k`` nearest rows of a cell; ties by id."""
    import numpy as np

    d = _distances(q, x, metric)
    return [[(float(row[j]), ids[j]) for j in np.lexsort((ids, row))[:k] if np.isfinite(row[j])] for row in d]


def search_many(spark: SparkSession, path: str, queries: DataFrame, k: int, key: str, query_key: str, probes: int | None = None, vector_col: str = "embedding", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, key, distance, rank): for each query the ``k`` nearest rows in its own nearest cells; ties by key.

    Queries of less than ``query_bytes`` go to every task, which compares a cell's rows with the queries that probe
    it. More of them meet rows by the number of the cell, in blocks of a cell's queries and slices of its rows.
    """
    import numpy as np
    import pandas as pd

    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    c, metric, p = np.array(meta["centroids"]), meta["metric"], probes or meta["probes"]
    cells = spark.read.parquet(f"{path}/cells").select(key, vector_col, "cell")
    qk, sk = queries.schema[query_key].dataType.simpleString(), cells.schema[key].dataType.simpleString()
    asked = queries.where(F.col(vector_col).isNotNull()).select(F.col(query_key).alias("_q"), F.col(vector_col).cast("array<double>").alias("_v"))
    schema, own = f"_q {qk}, _k {sk}, distance double", (c * c).sum(axis=1)[None, :]

    def near(q):
        return np.argsort(own - 2 * (_unit(q) if metric == "vector_cosine_ops" else q) @ c.T, axis=1, kind="stable")[:, :p]

    matrix = lambda column: np.stack(column.to_numpy()).astype(float)
    rows = lambda found: pd.DataFrame(found, columns=["_q", "_k", "distance"])
    size = 8 * c.shape[1] + 64
    if asked.count() * size <= query_bytes:
        block = asked.collect()  # bounded by ``query_bytes``
        qids, q = [r[0] for r in block], np.array([r[1] for r in block], float).reshape(len(block), c.shape[1])
        at = near(q)
        asks = {int(j): np.flatnonzero((at == j).any(axis=1)) for j in np.unique(at)}

        def run(batches: Iterator) -> Iterator:
            best: dict[int, list] = {}
            for pdf in batches:
                for cell, part in pdf.groupby("cell"):
                    x, ids, who = matrix(part[vector_col]), part[key].to_numpy(), asks.get(int(cell), ())
                    for i, found in zip(who, _cell_best(q[who], x, ids, k, metric) if len(who) else (), strict=True):
                        best[i] = sorted(best.get(i, []) + found)[:k]
            yield rows([(qids[i], j, d) for i, b in best.items() for d, j in b])

        found = cells.where(F.col("cell").isin(list(asks))).mapInPandas(run, schema)
    else:

        def route(batches: Iterator) -> Iterator:
            for pdf in batches:
                if len(pdf):
                    at = near(matrix(pdf["_v"]))
                    take = np.repeat(np.arange(len(pdf)), at.shape[1])
                    yield pdf.iloc[take].assign(cell=at.ravel().astype("int32"))

        asks = asked.mapInPandas(route, f"_q {qk}, _v array<double>, cell int")
        pieces = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") * size / query_bytes).cast("int").alias(name))
        plan = F.broadcast(pieces(asks, "blocks").join(pieces(cells, "slices"), "cell"))  # a row a cell
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        left = asks.join(plan, "cell").select("_q", "_v", "cell", deal("_q", "blocks").alias("_b"), every("slices").alias("_s"))
        right = cells.join(plan, "cell").select(F.col(key).alias("_k"), F.col(vector_col).alias("_v"), "cell", deal(key, "slices").alias("_s"), every("blocks").alias("_b"))

        def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return rows([])
            best = _cell_best(matrix(a["_v"]), matrix(b["_v"]), b["_k"].to_numpy(), k, metric)
            return rows([(i, j, d) for i, own in zip(a["_q"], best, strict=True) for d, j in own])

        found = left.groupBy("cell", "_b", "_s").cogroup(right.groupBy("cell", "_b", "_s")).applyInPandas(tile, schema)
    rank = F.row_number().over(Window.partitionBy("_q").orderBy("distance", "_k"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("_q").alias("query_id"), F.col("_k").alias(key), "distance", "rank")


def may_build(rows: int, pending: int, exists: bool, min_rows: int = 100_000, create_when_queue_empty: bool = True) -> bool:
    """The policy for building an index: none yet, an empty queue if asked for, and rows enough."""
    return not exists and not (create_when_queue_empty and pending > 0) and rows >= min_rows
