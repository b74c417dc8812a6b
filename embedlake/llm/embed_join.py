"""Operator 10: near-duplicate embeddings by an exact metric range join.

Within a label, pivots split the unit sphere into cells: a vector's home is the cell of its nearest pivot.
A vector also goes to every other cell that could hold a partner. With angular distance and radius ``r``,
the triangle inequality gives: a partner at home in cell c is at most d(v, home) + 2r from c's pivot, so c
is reached only if d(v, c) <= d(v, home) + 2r. For the planes between two pivots on a sphere this sharpens
to the angle between v and the plane being at most r; both are applied, with a margin above rounding. Every
pair within reach thus meets in the home cell of either side, and cells join on their own.

Cells are of two sizes. A label of more than ``CELL`` vectors is split into cells that travel: their number
grows with the label, and a row is sent once to each that it reaches. Within a task, rows are split again by
pivots of their own into cells of ``INNER`` rows or so, and only rows that reach a cell are compared with it.
A travelling cell of more than ``BLOCK`` rows is cut into blocks, and a task takes two of them, so a hot label
or cell becomes more tasks of the same size. A task gives counts and a spanning forest of its links, not the
pairs.

Pivots are a bounded sample (``PIVOTS`` in all, for labels by size); they decide only how the work is split.
All vectors are compared exactly, by cosine in double precision. Isolated vectors in many dimensions are as far
from any pivot as from another, so they reach most cells: work among them approaches all pairs of a label.

Cases: null labels, and null, empty, zero or non-finite vectors link with nothing and are returned with 0
links; vectors of different lengths do not link; equal vectors link; rows that repeat an id are vectors of
their own while counting links; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlake.llm._work import Workspace, connected_components

#: Rows of a block; a task holds two blocks, and products of ``CHUNK`` rows with a block.
BLOCK, CHUNK = 16_384, 256
#: Rows of a label, or of a task, for each of its pivots.
CELL, INNER = 16_384, 256
PIVOTS, INNER_PIVOTS = 16_384, 64


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pivots(rows: DataFrame, sizes: DataFrame, cell: int) -> dict[tuple, np.ndarray]:
    """Unit pivots of the largest (label, length) groups: the rows with the smallest hashes, ``PIVOTS`` in all."""
    large = sizes.where(F.col("n") > cell).orderBy(F.desc("n"), "label", "dim").limit(PIVOTS // 2).collect()
    wanted, left = {}, PIVOTS
    for r in large:
        wanted[r["label"], r["dim"]] = min(-(-r["n"] // cell), left // 2 if len(large) > 1 else left)
        left -= wanted[r["label"], r["dim"]]
    wanted = {k: v for k, v in wanted.items() if v > 1}
    if not wanted:
        return {}
    spark = rows.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    ask = spark.createDataFrame([(*k, v) for k, v in wanted.items()], f"label {kinds['label']}, dim int, parts int")
    picked = (
        rows.select("label", "dim", "vec").join(F.broadcast(ask), ["label", "dim"])
        .select("label", "dim", "parts", F.struct(F.xxhash64("vec").alias("o"), "vec").alias("x"))
        .groupBy("label", "dim", F.pmod("x.o", "parts").alias("part")).agg(F.min("x").alias("x"))
    )
    found: dict[tuple, list] = {}
    for r in picked.collect():  # a row a pivot
        found.setdefault((r["label"], r["dim"]), []).append((r["x"]["o"], r["x"]["vec"]))
    return {k: _unit(np.array([v for _, v in sorted(f)], np.float64)) for k, f in found.items()}


def reached(unit: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each row, and for each row and cell if a partner could be at home there."""
    margin, reach = 1e-9, math.sin(min(radius, math.pi / 2))
    cos = np.clip(unit @ pivots.T, -1, 1)
    home = cos.argmax(axis=1)
    best = cos[np.arange(len(unit)), home]
    apart = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 1e-300))[home]
    plane = (best[:, None] - cos) <= reach * apart + margin
    near = np.arccos(cos) <= np.arccos(best)[:, None] + 2 * radius + margin
    ok = plane & near
    ok[np.arange(len(unit)), home] = True
    return home, ok


def _cells(rows: DataFrame, pivots: dict, radius: float) -> DataFrame:
    """Rows with their home cell and the other cells that they can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, dim = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            groups: dict[tuple, list[int]] = {}
            for k, key in enumerate(zip(label, dim, strict=True)):
                groups.setdefault(key, []).append(k)
            for key, every in groups.items():
                p = pivots.get(key)
                most = len(every) if p is None else max(1, (4 << 20) // len(p))
                for k in range(0, len(every), most):
                    own = every[k : k + most]
                    part = batch.take(pa.array(own, pa.int64()))
                    if p is None or len(p) < 2:
                        home, lists = np.zeros(len(own), np.int32), [[0]] * len(own)
                    else:
                        home, ok = reached(_unit(_matrix(part.column(3))), p, radius)
                        lists = [np.flatnonzero(o).tolist() for o in ok]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home.astype(np.int32)), pa.array(lists, pa.list_(pa.int32()))], [*batch.schema.names, "home", "cells"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in rows.columns) + ", home int, cells array<int>"
    return rows.mapInArrow(run, schema)


def compared(left: np.ndarray, right: np.ndarray, threshold: float, inner: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of ``left``, rows of ``right``, which pairs reach the threshold), all that do; by cells of ``inner`` rows or so."""
    n = min(INNER_PIVOTS, len(right) // inner)
    if n > 1:
        pivots, radius = right[np.linspace(0, len(right) - 1, n).astype(int)], math.acos(threshold)
        home = (left @ pivots.T).argmax(axis=1)
        ok = reached(right, pivots, radius)[1]
        cells = [(np.flatnonzero(home == c), np.flatnonzero(ok[:, c])) for c in range(n)]
    else:
        cells = [(np.arange(len(left)), np.arange(len(right)))]
    for a, b in cells:
        for k in range(0, len(a), CHUNK):
            own = a[k : k + CHUNK]
            yield own, b, left[own] @ right[b].T >= threshold


def _tiles(spread: DataFrame, threshold: float, inner: int) -> DataFrame:
    """Per two blocks of a cell: (kind 0) links of a row that is at home there, (kind 1) forest links."""

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        own, at_home = table.column("own").to_numpy(), table.column("at_home").to_numpy(zero_copy_only=False)
        ids = table.column("uid").to_numpy()
        vec = _unit(_matrix(table.column("vec").combine_chunks()))
        n, up = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for x, y in ((i, j), (j, i))[: 1 if i == j else 2]:
            a, b = np.flatnonzero((own == x) & at_home), np.flatnonzero(own == y)
            for left, right, hit in compared(vec[a], vec[b], threshold, inner):
                left, right = a[left], b[right]
                hit &= left[:, None] != right[None, :]
                many = hit.sum(axis=1)
                n[left] += many
                for k in np.flatnonzero(many).tolist():
                    both = np.append(right[hit[k]], left[k])
                    root = up[both]
                    while (up[root] != root).any():
                        root = up[root]
                    up[both] = up[root] = root.min()
        while (up[up] != up).any():
            up = up[up]
        joined, some = np.flatnonzero(up != np.arange(len(ids))), np.flatnonzero(n)
        return pa.Table.from_arrays(
            [
                pa.array(np.append(np.zeros(len(some), np.int32), np.ones(len(joined), np.int32))),
                pa.array(np.append(ids[some], ids[joined])), pa.array(np.append(n[some], ids[up[joined]])),
            ],
            ["kind", "uid", "value"],
        )

    return spread.groupBy("label", "dim", "cell", "i", "j").applyInArrow(run, "kind int, uid bigint, value bigint")


def near_vectors(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    cell: int = CELL, block: int = BLOCK, inner: int = INNER,
) -> DataFrame:
    """id, n_links, component_id (smallest id that links reach) and kept (id = component_id) of each row.

    ``cell``, ``block`` and ``inner`` say how the work is split; the results don't depend on them.
    """
    ws = Workspace(vectors.sparkSession, "embed-join")
    kind = vectors.schema[vec_col].dataType.simpleString()
    v = F.col(vec_col) if kind in ("array<float>", "array<double>") else F.col(vec_col).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    live = F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & ~odd & F.exists(v, lambda x: x != 0)
    base = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("label"), F.when(F.coalesce(live, F.lit(False)), v).alias("vec"))
    # a row number that stays: it tells rows with the same id apart
    base = ws.save(base.withColumn("uid", F.monotonically_increasing_id()), "rows")
    rows = base.where("vec is not null").select("uid", "label", F.size("vec").alias("dim"), "vec")
    sizes = ws.save(rows.groupBy("label", "dim").agg(F.count("*").alias("n")), "sizes")
    pivots = _pivots(rows, sizes, cell)
    celled = rows.select("*", F.lit(0).alias("home"), F.array(F.lit(0)).alias("cells")) if not pivots else ws.save(_cells(rows, pivots, math.acos(threshold)), "cells")
    members = celled.select("uid", "label", "dim", "vec", "home", F.explode("cells").alias("cell"))
    blocks = ws.save(members.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("nb")), "blocks")
    placed = members.join(blocks, ["label", "dim", "cell"]).withColumn("own", F.pmod(F.xxhash64("uid"), "nb").cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "label", "dim", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", (F.col("home") == F.col("cell")).alias("at_home"), "uid", "vec"
    )
    out = ws.save(_tiles(spread, threshold, inner), "tiles")
    ws.drop("cells")
    counts = out.where("kind = 0").groupBy("uid").agg(F.sum("value").alias("n_links"))
    # links run between rows; components are named by ids
    comps = connected_components(ws, out.where("kind = 1").select(F.col("uid").alias("a"), F.col("value").alias("b")))
    named = ws.save(base.select("uid", "_id").join(counts, "uid", "left").join(comps.withColumnRenamed("node", "uid"), "uid", "left").select("_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("comp", "uid").alias("comp")), "named")
    least = ws.save(named.groupBy("comp").agg(F.min("_id").alias("least")), "least")
    ws.drop("tiles", "rows")
    return named.join(least, "comp").select(F.col("_id").alias(id_col), "n_links", F.col("least").alias("component_id"), (F.col("_id") == F.col("least")).alias("kept"))
