"""Approximate search by graphs in cells, kept up to date by segments.

Vectors go to the cell of their nearest centroid; a cell's rows, in parts of a bounded size, are leaves. A leaf is one
row of the index table: its keys, its different vectors, a graph of bounded degree over them, and codes of a few bits
a dimension. Edges of the graph are near vectors and some far ones, pruned so that no edge is kept that another
one, shorter by the factor ``max_alpha``, leads past. A search walks the graphs of a query's nearest cells from some
entries on, always from the nearest vector that it has not left yet, and keeps ``search_list_size`` vectors; with the
layout ``memory_optimized`` it walks by the codes and works out distances of the vectors that it has kept at the end.
All queries of a block walk at once. Copies of a vector are one node with several keys. A leaf of which a walk would meet
most vectors anyway is compared whole, which also finds the nearest of it for certain.

The table has one pointer that a rename replaces, so a reader sees an index as it was before a change or after it.
An upsert appends a segment: leaves of the new rows, by the same centroids, and the keys that are no longer valid in
segments before. A search drops hits that a later segment has taken back. ``compact`` builds the index anew from
its live rows.

Rows whose vector is null, of another length, or holds null or non-finite components are not indexed.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedlake.operators import ivf
from embedlake.operators.knn import QUERY_BYTES, _distances
from embedlake.plans.store import Table

#: Rows and bytes of vectors of a leaf, about; bytes that a step of a walk or of a build works on; queries of a block.
LEAF_ROWS, LEAF_BYTES, WORK, BLOCK = 4096, 8 << 20, 8 << 20, 512
#: A leaf of at most so many times ``search_list_size`` vectors is compared whole.
WHOLE = 8
#: Vectors from which a walk starts, and far candidates of a node.
ENTRIES, FAR = 32, 16
#: Share of rows taken back from which an index should be built anew.
STALE = 0.1
#: Taken-back keys that are broadcast at most.
FEW = 200_000


@dataclass(frozen=True)
class Options:
    """How leaves are built and walked; ``num_bits_per_dimension`` 0: two up to 900 dimensions, else one."""

    num_neighbors: int = 50
    search_list_size: int = 100
    max_alpha: float = 1.2
    num_bits_per_dimension: int = 0
    storage_layout: str = "memory_optimized"
    candidates: int = 64

    @staticmethod
    def of(indexing: dict) -> Options:
        """The options that an indexing configuration sets."""
        if indexing.get("implementation") == "hnsw":
            return Options(num_neighbors=2 * (indexing.get("m") or 16), candidates=indexing.get("ef_construction") or 64, max_alpha=1.0, storage_layout="plain")
        names = ("num_neighbors", "search_list_size", "max_alpha", "num_bits_per_dimension", "storage_layout")
        return Options(**{n: indexing[n] for n in names if indexing.get(n) is not None})

    def bits(self, dims: int) -> int:
        return self.num_bits_per_dimension or (2 if dims < 900 else 1)


def thresholds(x: np.ndarray, bits: int) -> np.ndarray:
    """For each dimension ``bits`` values that split a normal distribution with its mean and deviation evenly."""
    from statistics import NormalDist

    z = [NormalDist().inv_cdf((k + 1) / (bits + 1)) for k in range(bits)]
    return x.mean(axis=0)[:, None] + x.std(axis=0)[:, None] * np.array(z)


def encode(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Codes of rows: a bit for each dimension and threshold that is exceeded, so that Hamming distances add up levels."""
    return np.packbits((x[:, :, None] > cuts[None]).reshape(len(x), -1), axis=1)


def pruned(x: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each row at most ``degree`` of its candidates (-1: none), nearest first; none that a chosen one leads past."""
    n, c = candidates.shape
    out = np.full((n, degree), -1, np.int32)
    norm = (x * x).sum(axis=1)
    step = max(1, WORK // (8 * c * max(c, x.shape[1])))
    for at in range(0, n, step):
        rows = np.arange(at, min(n, at + step))
        own = candidates[rows]
        d = norm[rows][:, None] + norm[own] - 2 * np.einsum("rd,rcd->rc", x[rows], x[own])
        d = np.where((own < 0) | (own == rows[:, None]), np.inf, np.maximum(d, 0))
        order = np.lexsort((own, d), axis=1)
        own, d = np.take_along_axis(own, order, 1), np.take_along_axis(d, order, 1)
        alive = np.isfinite(d)
        alive[:, 1:] &= own[:, 1:] != own[:, :-1]
        v = x[own]
        between = norm[own][:, :, None] + norm[own][:, None, :] - 2 * v @ v.transpose(0, 2, 1)
        count = np.zeros(len(rows), np.int64)
        for j in range(c):
            take = alive[:, j] & (count < degree)
            out[rows[take], count[take]] = own[take, j]
            count += take
            alive &= ~(take[:, None] & (alpha * alpha * between[:, j] <= d))
    return out


def graph_of(x: np.ndarray, o: Options) -> np.ndarray:
    """The neighbours of each of the different vectors ``x``, padded with -1."""
    n = len(x)
    if n <= o.num_neighbors + 1:
        every = np.tile(np.arange(n, dtype=np.int32), (n, 1))
        return np.where(every == np.arange(n)[:, None], -1, every)
    x = x.astype(np.float64)
    c, norm = min(n - 1, o.candidates), (x * x).sum(axis=1)
    near, step = np.empty((n, c), np.int64), max(1, WORK // (8 * n))
    for at in range(0, n, step):
        d = norm[at : at + step, None] + norm[None, :] - 2 * x[at : at + step] @ x.T
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        near[at : at + step] = np.argpartition(d, c - 1, axis=1)[:, :c]
    far = np.random.default_rng(n).integers(0, n, (n, min(FAR, n)))
    first = pruned(x, np.concatenate([near, far], axis=1), o.num_neighbors, o.max_alpha)
    src, slot = np.nonzero(first >= 0)
    dst = first[src, slot]
    order = np.lexsort((slot, dst))  # each node's callers, those to whom it is nearest first
    src, dst = src[order], dst[order]
    begin = np.searchsorted(dst, np.arange(n))
    place = np.arange(len(dst)) - begin[dst]
    back = np.full((n, o.num_neighbors), -1, np.int64)
    some = place < o.num_neighbors
    back[dst[some], place[some]] = src[some]
    return pruned(x, np.concatenate([first, back], axis=1), o.num_neighbors, o.max_alpha)


def walk(graph: np.ndarray, n: int, queries: int, distance, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids (-1: none) and distances of the ``width`` nearest vectors that each query meets, and how many distances were worked out.

    ``distance(q, ids)`` gives those of queries ``q`` to a row of ids each.
    """
    entries = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int64))
    ids, dist = np.full((queries, width), -1, np.int64), np.full((queries, width), np.inf)
    left, seen = np.ones((queries, width), bool), np.zeros((queries, n), bool)
    every, compared = np.arange(queries), 0

    def meet(q: np.ndarray, found: np.ndarray) -> None:
        nonlocal compared
        new = (found >= 0) & ~seen[q[:, None], np.maximum(found, 0)]
        seen[np.repeat(q, found.shape[1])[new.ravel()], found[new]] = True
        compared += int(new.sum())
        d = np.where(new, distance(q, np.maximum(found, 0)), np.inf)
        both, all_ = np.concatenate([dist[q], d], axis=1), np.concatenate([ids[q], np.where(new, found, -1)], axis=1)
        done = np.concatenate([left[q], np.zeros(found.shape, bool)], axis=1)
        best = np.argsort(both, axis=1, kind="stable")[:, :width]
        ids[q], dist[q], left[q] = np.take_along_axis(all_, best, 1), np.take_along_axis(both, best, 1), np.take_along_axis(done, best, 1)

    meet(every, np.tile(entries, (queries, 1)))
    while True:
        open_ = np.isfinite(dist) & ~left
        q = np.flatnonzero(open_.any(axis=1))
        if not len(q):
            return ids, dist, compared
        slot = np.argmax(open_[q], axis=1)  # lists are sorted
        left[q, slot] = True
        meet(q, graph[ids[q, slot]].astype(np.int64))


@dataclass
class Leaf:
    """One row of the index."""

    vectors: np.ndarray
    graph: np.ndarray
    codes: np.ndarray | None
    owner: np.ndarray

    @staticmethod
    def build(x: np.ndarray, o: Options, cuts: np.ndarray | None, metric: str) -> Leaf:
        different, owner = np.unique(x, axis=0, return_inverse=True)
        unit = space = ivf._unit(different.astype(np.float64)) if metric == "vector_cosine_ops" else different
        if metric == "vector_ip_ops":  # one more dimension, in which large products are short distances
            size = (different.astype(np.float64) ** 2).sum(axis=1)
            space = np.concatenate([different, np.sqrt(size.max() - size)[:, None]], axis=1)
        return Leaf(different, graph_of(space, o), None if cuts is None else encode(unit, cuts), owner.ravel().astype(np.int32))

    def search(self, q: np.ndarray, metric: str, o: Options, cuts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
        """For each query the ids of different vectors and their exact distances, nearest first; and the distances worked out."""
        cosine = metric == "vector_cosine_ops"
        width = max(1, min(o.search_list_size, len(self.vectors)))
        base = ivf._unit(self.vectors.astype(np.float64)) if cosine else self.vectors.astype(np.float64)
        asked = ivf._unit(q) if cosine else q
        codes = encode(asked, cuts) if self.codes is not None else None

        def distance(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
            if codes is not None:
                return np.bitwise_count(self.codes[ids] ^ codes[rows][:, None]).sum(axis=2, dtype=np.int64).astype(float)
            if metric == "vector_l1_ops":
                return np.abs(base[ids] - asked[rows][:, None]).sum(axis=2)
            d = -np.einsum("rd,rcd->rc", asked[rows], base[ids])
            return d if metric != "vector_l2_ops" else 2 * d + (base[ids] ** 2).sum(axis=2)

        if len(base) <= WHOLE * width:
            return self._whole(q, metric, width)
        step = max(1, WORK // (8 * max(1, self.graph.shape[1], ENTRIES) * base.shape[1]))
        ids, compared = np.full((len(q), width), -1, np.int64), 0
        for at in range(0, len(q), step):
            own = np.arange(at, min(len(q), at + step))
            ids[own], _, n = walk(self.graph, len(base), len(own), lambda rows, found, own=own: distance(own[rows], found), width)
            compared += n
        exact = np.full(ids.shape, np.inf)
        for k in range(len(q)):
            some = ids[k] >= 0
            exact[k, some] = _distances(q[k : k + 1].astype(float), self.vectors[ids[k, some]].astype(float), metric)[0]
        order = np.argsort(exact, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(exact, order, 1), compared

    def _whole(self, q: np.ndarray, metric: str, width: int) -> tuple[np.ndarray, np.ndarray, int]:
        """As ``search``, by the distances to all vectors."""
        n = len(self.vectors)
        ids, exact, step = np.empty((len(q), width), np.int64), np.empty((len(q), width)), max(1, WORK // (8 * n))
        for at in range(0, len(q), step):
            d = _distances(q[at : at + step].astype(float), self.vectors.astype(float), metric)
            near = np.sort(np.argpartition(d, width - 1, axis=1)[:, :width], axis=1)
            order = np.argsort(own := np.take_along_axis(d, near, 1), axis=1, kind="stable")
            ids[at : at + step], exact[at : at + step] = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
        return ids, exact, len(q) * n


def _matrix(column: pa.Array, dims: int, kind: str) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims)


class Index:
    """An index below ``path``. ``keys`` name the columns that identify a row."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], vector_col: str = "embedding"):
        self.spark, self.keys, self.vector_col = spark, list(keys), vector_col
        self.table = Table(spark, path)

    def exists(self) -> bool:
        return self.table.exists()

    def meta(self) -> dict:
        return json.loads(self.table.read().where("kind = 'meta'").select("meta").first()[0])

    def _key(self) -> Column:
        return F.col(self.keys[0]) if len(self.keys) == 1 else F.struct(*self.keys)

    def _usable(self, store: DataFrame, dims: int | None) -> DataFrame:
        v = F.col(self.vector_col)
        fit = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return store.where(fit if dims is None else fit & (F.size(v) == dims)).select(self._key().alias("_k"), F.xxhash64(*self.keys).alias("_h"), v.alias("_v"))

    def _schema(self, kind: T.DataType) -> T.StructType:
        s, i, b = T.StringType(), T.IntegerType(), T.BinaryType()
        fields = [("kind", s), ("seq", i), ("cell", i), ("keys", T.ArrayType(kind)), ("owner", b), ("vectors", b), ("graph", b), ("codes", b), ("meta", s)]
        return T.StructType([T.StructField(n, t) for n, t in fields])

    def _leaves(self, rows: DataFrame, meta: dict, seq: int) -> DataFrame:
        """Leaves of ``rows`` (_k, _h, _v): by cell, in parts of a bounded size."""
        from pyspark.sql.pandas.types import to_arrow_schema

        dims, kind, metric = meta["dims"], meta["float"], meta["metric"]
        centroids, cuts, o = np.array(meta["centroids"]), np.array(meta["cuts"]) if meta["cuts"] else None, Options(**meta["options"])
        cosine = metric == "vector_cosine_ops"

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(2), dims, "f8")
                cell = ivf._assign(ivf._unit(x) if cosine else x, centroids) if len(x) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])

        schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])
        celled = rows.mapInArrow(placed, schema)
        most = max(1, min(LEAF_ROWS, LEAF_BYTES // (4 * dims)))
        parts = celled.groupBy("cell").agg(F.ceil(F.count("*") / most).alias("parts"))  # a row a cell
        dealt = celled.join(F.broadcast(parts), "cell").withColumn("part", F.pmod("_h", "parts"))
        out = self._schema(rows.schema["_k"].dataType)
        arrow = to_arrow_schema(out)

        def leaf(key: tuple, t: pa.Table) -> pa.Table:
            t = t.combine_chunks()
            order = np.argsort(t.column("_h").to_numpy(), kind="stable")
            t = t.take(pa.array(order)).combine_chunks()
            column = t.column("_v").combine_chunks()
            x = Leaf.build(_matrix(column if isinstance(column, pa.Array) else column.chunk(0), dims, kind), o, cuts, metric)
            row = {
                "kind": "leaf", "seq": seq, "cell": key[0].as_py(), "keys": t.column("_k").to_pylist(), "owner": x.owner.tobytes(), "vectors": x.vectors.tobytes(),
                "graph": x.graph.astype(np.int32).tobytes(), "codes": None if x.codes is None else x.codes.tobytes(), "meta": None,
            }
            return pa.Table.from_pylist([row], schema=arrow)

        return dealt.select("cell", "part", "_k", "_h", "_v").groupBy("cell", "part").applyInArrow(leaf, out)

    def build(self, store: DataFrame, metric: str = "vector_cosine_ops", options: Options | None = None, cells: int | None = None, sample: int = ivf.SAMPLE) -> dict:
        """Index all rows. Centroids, thresholds and the number of probes come from a bounded sample."""
        o = options or Options()
        one = self._usable(store, None).select(F.size("_v")).first()
        dims = one[0] if one else 1
        rows = self._usable(store, dims)
        n = rows.count()
        kind = "f8" if store.schema[self.vector_col].dataType.elementType == T.DoubleType() else "f4"
        most = min(sample, max(1, ivf.SAMPLE_BYTES // (8 * dims)))
        column = rows.orderBy("_h", F.xxhash64("_v")).limit(most).select("_v").toArrow().column(0).combine_chunks()
        x = _matrix(column, dims, "f8") if len(column) else np.zeros((1, dims))
        cosine = metric == "vector_cosine_ops"
        unit = ivf._unit(x) if cosine else x
        cells = max(1, min(cells or math.isqrt(max(1, n)) // 2, ivf.MAX_CELLS, len(x)))
        centroids = ivf._kmeans(unit.copy(), cells)
        cuts = thresholds(unit, o.bits(dims)).tolist() if o.storage_layout == "memory_optimized" else None
        meta = {
            "metric": metric, "dims": dims, "float": kind, "rows": n, "cells": len(centroids), "probes": ivf._probes(x, centroids, cosine),
            "centroids": centroids.tolist(), "cuts": cuts, "options": asdict(o),
        }
        leaves = self._leaves(rows, meta, 0)
        head = self.spark.createDataFrame([("meta", 0, json.dumps(meta))], "kind string, seq int, meta string")
        self.table.write(leaves.unionByName(head, allowMissingColumns=True))
        return meta

    def upsert(self, new: DataFrame, gone: DataFrame | None = None) -> int:
        """Append a segment in which the rows of ``new`` replace those of their keys, and those of ``gone`` are taken back; its number."""
        meta = self.meta()
        seq = self.table.read().agg(F.max("seq")).first()[0] + 1
        keys = new.select(self._key().alias("_k"), F.xxhash64(*self.keys).alias("_h"))
        if gone is not None:
            keys = keys.unionByName(gone.select(self._key().alias("_k"), F.xxhash64(*self.keys).alias("_h")))
        n = keys.count()
        dead = keys.groupBy(F.pmod("_h", F.lit(max(1, n // LEAF_ROWS))).alias("part")).agg(F.collect_set("_k").alias("keys")).select(F.lit("dead").alias("kind"), F.lit(seq).alias("seq"), "keys")
        leaves = self._leaves(self._usable(new, meta["dims"]), meta, seq)
        self.table.append(leaves.unionByName(dead, allowMissingColumns=True))
        return seq

    def _dead(self) -> DataFrame:
        """(_k, since): keys and the last segment that took them back."""
        rows = self.table.read().where("kind = 'dead'").select(F.explode("keys").alias("_k"), "seq")
        return rows.groupBy("_k").agg(F.max("seq").alias("since"))

    def _live(self, rows: DataFrame) -> DataFrame:
        """``rows`` (_k, seq, ...) that no later segment has taken back."""
        dead = self._dead().withColumnRenamed("_k", "_d")
        few = dead.limit(FEW + 1).count()
        if not few:
            return rows
        return rows.join(F.broadcast(dead) if few <= FEW else dead, rows["_k"].eqNullSafe(F.col("_d")) & (F.col("since") > rows["seq"]), "left_anti")

    def rows(self) -> DataFrame:
        """The keys and vectors that are live."""
        meta, leaves = self.meta(), self.table.read().where("kind = 'leaf'")
        dims, kind = meta["dims"], meta["float"]
        element = T.DoubleType() if kind == "f8" else T.FloatType()
        key = leaves.schema["keys"].dataType.elementType
        out = T.StructType([T.StructField("_k", key), T.StructField("seq", T.IntegerType()), T.StructField("_v", T.ArrayType(element))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    keys = batch.column("keys").slice(k, 1).flatten()
                    x = np.frombuffer(batch.column("vectors")[k].as_py(), kind).reshape(-1, dims)[np.frombuffer(batch.column("owner")[k].as_py(), np.int32)]
                    v = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dims, dtype=np.int32)), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(keys), batch.column("seq")[k].as_py(), np.int32)), v], ["_k", "seq", "_v"])

        live = self._live(leaves.select("seq", "keys", "owner", "vectors").mapInArrow(run, out))
        return live.select(*([F.col("_k").alias(self.keys[0])] if len(self.keys) == 1 else [F.col(f"_k.{c}").alias(c) for c in self.keys]), F.col("_v").alias(self.vector_col))

    def stale(self) -> bool:
        """Whether so many rows were taken back that the index should be built anew."""
        held = self.table.read().groupBy("kind").agg(F.sum(F.size("keys")).alias("n"))
        n = {r["kind"]: r["n"] or 0 for r in held.collect()}
        return n.get("dead", 0) > STALE * max(1, n.get("leaf", 0))

    def compact(self) -> dict:
        """Build the index anew from its live rows; readers see the old one until it is there."""
        meta = self.meta()
        return self.build(self.rows(), meta["metric"], Options(**meta["options"]))

    @staticmethod
    def _blocks(asks: DataFrame) -> DataFrame:
        """(cell, _b, _asks): the queries (_q, _v, cell) of each cell, in as few blocks of ``BLOCK`` or so as hold them."""
        many = asks.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("many"))  # a row a cell
        return asks.join(F.broadcast(many), "cell").groupBy("cell", F.pmod(F.xxhash64("_q"), "many").alias("_b")).agg(F.collect_list(F.struct("_q", "_v")).alias("_asks"))

    def search_many(self, queries: DataFrame, k: int, query_key: str, query_vector: str = "embedding", probes: int | None = None, query_bytes: int = QUERY_BYTES, counts: bool = False, **options) -> DataFrame:
        """(query_id, keys, distance, rank): for each query the ``k`` nearest rows that the walks in its nearest cells meet.

        ``options`` replace those that the index was built with, such as ``search_list_size``. Queries meet leaves by
        cell: blocks of them by broadcast if all are less than ``query_bytes``, else by a shuffle of blocks and leaves.
        With ``counts`` the rows are (block's query_id or null, compared): distances that each walk worked out.
        """
        meta = self.meta()
        dims, kind, metric, p = meta["dims"], meta["float"], meta["metric"], probes or meta["probes"]
        centroids, cuts = np.array(meta["centroids"]), np.array(meta["cuts"]) if meta["cuts"] else None
        o = Options(**{**meta["options"], "search_list_size": max(k, meta["options"]["search_list_size"]), **options})
        cosine, p = metric == "vector_cosine_ops", min(p, len(centroids))
        qv = F.col(query_vector)
        asked = queries.where(qv.isNotNull() & (F.size(qv) == dims)).select(F.col(query_key).alias("_q"), qv.cast("array<double>").alias("_v"))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1), dims, "f8")
                d = (centroids * centroids).sum(axis=1)[None, :] - 2 * (ivf._unit(x) if cosine else x) @ centroids.T
                near = np.argsort(d, axis=1, kind="stable")[:, :p]
                take = pa.array(np.repeat(np.arange(len(x)), p))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(near.ravel().astype(np.int32))], ["_q", "_v", "cell"])

        qtype = queries.schema[query_key].dataType
        asks = asked.mapInArrow(route, T.StructType([T.StructField("_q", qtype), T.StructField("_v", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType())]))
        n = asked.count()
        blocks = self._blocks(asks)
        leaves = self.table.read().where("kind = 'leaf'").select("seq", "cell", "keys", "owner", "vectors", "graph", "codes")
        if n * p * (8 * dims + 64) <= query_bytes:
            cells = [r[0] for r in blocks.select("cell").distinct().collect()]  # at most as many as there are centroids
            leaves, blocks = leaves.where(F.col("cell").isin(cells)), F.broadcast(blocks)
        else:  # walks cost more than their rows' bytes say, by which partitions would be put together
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            leaves, blocks = leaves.repartition(parts, "cell"), blocks.repartition(parts, "cell")
        key = leaves.schema["keys"].dataType.elementType
        fields = [("_q", qtype), ("_k", key), ("distance", T.DoubleType()), ("seq", T.IntegerType()), ("compared", T.LongType())]
        out = T.StructType([T.StructField(a, b) for a, b in fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    one = lambda c, r=r: batch.column(c)[r].as_py()
                    x = np.frombuffer(one("vectors"), kind).reshape(-1, dims)
                    codes = one("codes")
                    leaf = Leaf(x, np.frombuffer(one("graph"), np.int32).reshape(len(x), -1), None if codes is None or cuts is None or o.storage_layout == "plain" else np.frombuffer(codes, np.uint8).reshape(len(x), -1), np.frombuffer(one("owner"), np.int32))
                    asks_ = batch.column("_asks").slice(r, 1).flatten()
                    ids, d, compared = leaf.search(_matrix(asks_.field("_v"), dims, "f8"), metric, o, cuts)
                    # all keys of each vector that was met
                    order = np.argsort(leaf.owner, kind="stable")
                    size = np.bincount(leaf.owner, minlength=len(x))
                    begin = np.cumsum(size) - size
                    q, slot = np.nonzero((ids >= 0) & np.isfinite(d))
                    node = ids[q, slot]
                    times = size[node]
                    at = np.repeat(begin[node] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                    yield pa.RecordBatch.from_arrays([
                        asks_.field("_q").take(pa.array(np.repeat(q, times))), batch.column("keys").slice(r, 1).flatten().take(pa.array(order[at])), pa.array(np.repeat(d[q, slot], times)),
                        pa.array(np.full(len(at), one("seq"), np.int32)), pa.array(np.full(len(at), compared // max(1, len(asks_)), np.int64)),
                    ], [f[0] for f in fields])

        found = leaves.join(blocks, "cell").mapInArrow(run, out)
        if counts:
            return found.groupBy(F.col("_q").alias("query_id"), "seq").agg(F.max("compared").alias("compared"))
        live = self._live(found)
        w = Window.partitionBy("_q").orderBy("distance", "_k")
        named = [F.col("_k").alias(self.keys[0])] if len(self.keys) == 1 else [F.col(f"_k.{c}").alias(c) for c in self.keys]
        return live.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("_q").alias("query_id"), *named, "distance", "rank")

    def search(self, query: Sequence[float], k: int, **options) -> DataFrame:
        """The ``k`` nearest rows to one query, with ``distance``."""
        one = self.spark.createDataFrame([(0, [float(v) for v in query])], "q int, v array<double>")
        return self.search_many(one, k, "q", "v", **options).drop("query_id")
