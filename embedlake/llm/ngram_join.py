"""Operator 2: n-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct word n-grams. The sets of a size band share a sketch of
``blocks(band)`` blocks; each block keeps the exclusive-or of the hashes that fall into it. A token in one
set only changes at most one block, so two sets at most ``d`` tokens apart agree on all but ``d`` blocks.
By the pigeonhole principle, in any order of block contents common to all sets, the first ``d + 1`` occupied
blocks of either share one. That order puts contents made of frequent tokens last, so that passages shared
by many documents hardly ever bring pairs together. Pairs that meet are cut by a second sketch, one bit per
token toggled, whose Hamming distance never exceeds the symmetric difference; what is left is verified on
the sets themselves.

Equal sets are one node. Meeting points are read as sorted streams: a task holds one point's smallest node
and its last one, never the point. Points whose contents are estimated to be in more than ``SPLIT`` sets are
split by a salt, and the smallest nodes of the salts meet in a second step. Links are found in three rounds:
each node of a point against the point's smallest; then, where a point still holds different components, a
forest of close pairs; then all close pairs that are left between different components. The last two rounds
compare sketches as matrices in tiles of bounded size, of each set of nodes that meet in one point only; a
bucket of tiles gets a node's sketch once. So groups of copies cost a line each, and no link between
components is lost. Sets are not stored: texts are read again where tokens are needed, and for the
verification only the texts of candidates.

Cases: null, empty or wordless text has an empty set and no links; fewer than ``n`` words are one shingle;
a null id is kept, but such rows are never the smallest id; repeated rows link to each other; an empty
table gives no rows; only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlake.llm import _text as T
from embedlake.llm._work import Workspace, connected_components, only_ids

SLICE = 2 << 20
#: Counters of the table that orders block contents by how common their tokens are: 1 MB whatever the input.
COUNTERS = 1 << 18
PARTS = 64
_LOW48 = np.uint64((1 << 48) - 1)
#: Bits a token of the Hamming sketch, at least.
BITS_PER_TOKEN = 4
#: Sets that a meeting point, or a salt of it, gathers by estimate. The estimate is of the point's own tokens.
SPLIT = 200_000
#: Rows of a side of a tile, and of all tiles of a bucket.
TILE, BUCKET = 512, 20_000
#: Partners of a node that a task verifies; nodes with more are dealt out in parts.
FAN = 200
#: Rows that are broadcast at most, of 50 bytes or so; beyond it both sides are shuffled.
BROADCAST_ROWS = 300_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct 48-bit n-gram hashes of each row; fewer than ``n`` words are one n-gram."""
    lower = T.LOWER[data]
    starts, ends, first = T.words(lower, offsets)
    h = T.hashes(lower, starts, ends)
    g = T.grams(h, n) & _LOW48
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        else:
            out.append(T.grams(h[a:b], b - a) & _LOW48 if b > a else np.zeros(0, np.uint64))
    return out


def _pack48(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _node(h: np.ndarray) -> int:
    """A signed 63-bit fingerprint of a set; 0 or above."""
    with np.errstate(over="ignore"):
        return int((T.mix(h + T.K1).sum() ^ T.mix(T.mix(h) + np.uint64(len(h))).sum()) >> np.uint64(1))


def _arrow(column: pa.Array) -> Iterator[bytes]:
    return (v.as_py() for v in column)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_row"), F.col(text_col).alias("_text"))


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """(_id, _row, n_shingles, node, sketch) of each row of ``docs`` (_id, _row, _text); sketch is null where a task has had the node before.

    Besides, a few rows a task with ``part`` and ``counts``: how often tokens occur in its sets, by hashed counter.
    """
    per = COUNTERS // PARTS
    schema = f"_id {docs.schema['_id'].dataType.simpleString()}, _row bigint, n_shingles bigint, node bigint, sketch binary, part int, counts binary"
    names = ["_id", "_row", "n_shingles", "node", "sketch", "part", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, kind = set(), np.zeros(COUNTERS, np.int64), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b, data, offsets in T.slices(batch.column(2), SLICE):
                sets = shingle_sets(data, offsets, n)
                nodes = [_node(x) if len(x) else None for x in sets]
                first = [k is not None and k not in seen and not seen.add(k) for k in nodes]
                new = [x for x, f in zip(sets, first, strict=True) if f]
                if new:
                    total += np.bincount(_counter_slot(np.concatenate(new)), minlength=COUNTERS)
                columns = [
                    batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(x) for x in sets], pa.int64()), pa.array(nodes, pa.int64()),
                    pa.array([hamming_sketch(x) if f else None for x, f in zip(sets, first, strict=True)], pa.binary()), pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)
        parts = [k for k in range(PARTS) if total[k * per : (k + 1) * per].any()]
        if parts:
            empty = [pa.nulls(len(parts), t) for t in (kind, pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(parts, pa.int32()), pa.array([total[k * per : (k + 1) * per].astype("<i8").tobytes() for k in parts], pa.binary())], names)

    return docs.mapInArrow(run, schema)


def _counter_slot(h: np.ndarray) -> np.ndarray:
    return (T.mix(h) & np.uint64(COUNTERS - 1)).astype(np.int64)


def frequency_table(counted: DataFrame) -> bytes:
    """How often tokens occur, by hashed counter, over all sets: summed in parts, of a fixed size; as rounded logarithms."""
    per = COUNTERS // PARTS

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(per, np.int64)
        for batch in batches:
            for raw in _arrow(batch.column(1)):
                total += np.frombuffer(raw, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "counts"])

    out = np.zeros(COUNTERS, np.int64)
    for r in counted.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(add, "part int, counts binary").collect():
        out[r["part"] * per : (r["part"] + 1) * per] = np.frombuffer(r["counts"], "<i8")
    return np.ceil(np.log2(out + 1)).astype(np.uint8).tobytes()


def _block_keys(h: np.ndarray, rarity: np.ndarray, band: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``prefix`` occupied blocks of the band's parity sketch, rarest contents first: keys, and how common their contents are."""
    blocks = np.uint64(1 << (band + 2))
    at = T.mix(h ^ T.K2) & (blocks - np.uint64(1))
    order = np.argsort(at, kind="stable")
    at, own = at[order], h[order]
    begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    parity = np.bitwise_xor.reduceat(own, begin)
    common = np.minimum.reduceat(rarity[order], begin).astype(np.uint64)
    key = T.mix(T.mix(at[begin] * K_BAND + np.uint64(band)) ^ parity)
    if len(key) < prefix:  # more tokens share blocks than the bound allows for: such sets also meet each other
        return np.append(key, T.mix(np.array([band], np.uint64))), np.append(common, np.uint64(0))
    rank = (common << np.uint64(56)) | (key >> np.uint64(8))
    first = np.argpartition(rank, prefix - 1)[:prefix]
    return key[first], common[first]


K_BAND = np.uint64(0x100000001B3)


def meeting_points(docs: DataFrame, n: int, table: bytes, num: int, den: int, split: int = SPLIT) -> DataFrame:
    """(key, salt, node, n): the blocks by which sets of ``docs`` can meet others at least ``num``/``den`` alike.

    ``salt`` is -1, or for keys whose contents are in more than ``split`` sets by estimate, a part of the key.
    Equal contents have equal tokens, so all sets that have them know the same number of parts.
    """

    def flush(out: list, nodes: list, sizes: list) -> pa.RecordBatch:
        many = np.array([len(k) for k, _ in out], np.int64)
        node = np.repeat(np.array(nodes, np.int64), many)
        parts = -(-(1 << np.concatenate([c for _, c in out]).astype(np.int64)) // split)
        salt = np.where(parts > 1, (T.mix(node.view(np.uint64)) >> np.uint64(1)).astype(np.int64) % parts, -1).astype(np.int32)
        columns = [np.concatenate([k for k, _ in out]).view(np.int64), salt, node, np.repeat(np.array(sizes, np.int32), many)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "salt", "node", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = np.frombuffer(table, np.uint8), set()
        out, nodes, sizes, held = [], [], [], 0
        for batch in batches:
            for _, _, data, offsets in T.slices(batch.column(0), SLICE):
                for h in shingle_sets(data, offsets, n):
                    if not len(h) or (node := _node(h)) in seen:
                        continue
                    seen.add(node)
                    size, rarity = len(h), rank[_counter_slot(h)]
                    band = size.bit_length() - 1
                    # a partner has num/den * n to den/num * n tokens; the larger of a pair is at most den/num times the other
                    differ = max((den - num) * size // num, 2 * size * (den - num) // (den + num))
                    low = [band - 1] if band and size * num <= den * ((1 << band) - 1) else []
                    for b in (band, *low):
                        out.append(_block_keys(h, rarity, b, differ + 1))
                        nodes.append(node)
                        sizes.append(size)
                        held += len(out[-1][0])
                    if held > 200_000:
                        yield flush(out, nodes, sizes)
                        out, nodes, sizes, held = [], [], [], 0
        if out:
            yield flush(out, nodes, sizes)

    return docs.select("_text").mapInArrow(run, "key bigint, salt int, node bigint, n int")


def gathered(hits: DataFrame) -> DataFrame:
    """(key, salt, node, n, rep, rep_n) of the points at which different nodes meet; ``rep`` is the smallest node.

    A stream over sorted rows: what is kept between batches is the open point's smallest and last node. Parts of
    split keys are returned even if they hold one node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point, rep, told, last = None, (0, 0), True, 0  # of the open point: (key, salt), (smallest node, n), whether it is out, last node
        for batch in batches:
            if not batch.num_rows:
                continue
            k, s, x, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            new = np.append(point != (int(k[0]), int(s[0])), (k[1:] != k[:-1]) | (s[1:] != s[:-1]))
            begin = np.flatnonzero(new)
            group = np.cumsum(new) - (1 if new[0] else 0)  # with the open point, if it goes on, as group 0
            lead = x[begin] if new[0] else np.append(rep[0], x[begin])
            lead_n = n[begin] if new[0] else np.append(np.array([rep[1]], n.dtype), n[begin])
            other = x != lead[group]
            other[1:] &= new[1:] | (x[1:] != x[:-1])  # repeated rows of a node stand together
            other[0] &= bool(new[0]) or int(x[0]) != last
            plural = np.bincount(group[other], minlength=len(lead)) > 0
            at = np.flatnonzero(new & (plural[group] | (s >= 0)))
            rows = np.append(at, np.flatnonzero(other))
            columns = [k[rows], s[rows], x[rows], n[rows], lead[group[rows]], lead_n[group[rows]]]
            if not new[0] and plural[0] and not told:
                columns = [np.append(c, np.array([v], c.dtype)) for c, v in zip(columns, (*point, rep[0], rep[1], rep[0], rep[1]), strict=True)]
            told = bool(plural[-1]) or int(s[-1]) >= 0 or (len(lead) == 1 and not new[0] and told)
            point, rep, last = (int(k[-1]), int(s[-1])), (int(lead[-1]), int(lead_n[-1])), int(x[-1])
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "salt", "node", "n", "rep", "rep_n"])

    parts = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = hits.repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", "node")
    return dealt.mapInArrow(run, "key bigint, salt int, node bigint, n int, rep bigint, rep_n int")


def hamming_sketch(h: np.ndarray, per_token: int = BITS_PER_TOKEN) -> bytes:
    """A bit toggled by each token; a power of two of bits, so that sketches fold onto smaller ones."""
    bits = max(256, 1 << (per_token * len(h) - 1).bit_length())
    odd = np.bincount((T.mix(h ^ T.K3) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) != len(y):
        x, y = (x, y) if len(x) < len(y) else (y, x)
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _joined(df: DataFrame, few: DataFrame, column: str) -> DataFrame:
    """``df`` with the rows of ``few`` that have its ``column``: by broadcast if these are few, else by a shuffle of both."""
    small = few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(few) if small else few, column)


def grams_of(docs: DataFrame, n: int) -> DataFrame:
    """(node, n, grams) of ``docs`` (_text); once for each node of a task. ``grams`` holds 6 bytes a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in T.slices(batch.column(0), SLICE):
                new = [(k, x) for x in shingle_sets(data, offsets, n) if len(x) and (k := _node(x)) not in seen and not seen.add(k)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in new], pa.int64()), pa.array([len(x) for _, x in new], pa.int64()), pa.array([_pack48(x) for _, x in new], pa.binary())], ["node", "n", "grams"])

    return docs.select("_text").mapInArrow(run, "node bigint, n bigint, grams binary")


def _sides(pairs: DataFrame, fan: int) -> DataFrame:
    """(node, a, part, b): a row for the partner ``b`` of each pair, and one for ``a`` (b is null) in each of its parts."""
    per = pairs.groupBy("a").agg(F.ceil(F.count("*") / fan).cast("int").alias("parts"))
    lead = per.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"))
    rest = pairs.join(per, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    return lead.unionByName(rest)


def _checked(sides: DataFrame, keep) -> DataFrame:
    """Pairs (a, b) that ``keep(x, n, y, m)`` holds for. ``sides`` has the details (n, x) of both; a stream over sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, x, n = None, b"", 0
        for batch in batches:
            a, part, b, m = (batch.column(k).to_pylist() for k in range(4))
            found = []
            for k, y in enumerate(batch.column(4)):
                if b[k] is None:
                    lead, x, n = (a[k], part[k]), y.as_py(), m[k]
                elif lead == (a[k], part[k]) and keep(x, n, y.as_py(), m[k]):
                    found.append((a[k], b[k]))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    parts = int(sides.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sides.select("a", "part", "b", "n", "x").repartition(parts, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _fold(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of words, folded onto the shortest."""
    least = min(map(len, sketches))
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, least // 8), axis=0) for x in sketches])


def _close_in_tiles(met: DataFrame, blocks: DataFrame, sketches: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """(a, b) of nodes that meet, in different components, with sketches near enough.

    A point's rows fall into ``nb`` blocks of ``TILE`` or so, and a tile holds two of its blocks; a task compares
    sketches as matrices and gives only pairs that pass. Tiles are dealt out in buckets; a task holds the sketches of
    one bucket's nodes. ``forest``: of the pairs, only such that join two components that no pair before them in the
    tile has joined.
    """
    tile_rows = blocks.agg(F.sum(F.col("m") * F.col("nb"))).first()[0]
    buckets = -(-int(tile_rows) // BUCKET)
    placed = _joined(met, blocks.select("key", "nb"), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    tiled = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "node", "n", "comp"
    ).withColumn("bucket", F.pmod(F.xxhash64("key", "i", "j"), F.lit(buckets)))
    drawn = tiled.select("bucket", "node").distinct().join(sketches.select("node", "sketch"), "node")
    names = ["bucket", "key", "i", "j", "own", "node", "n", "comp"]
    kinds = {f.name: f.dataType for f in tiled.schema}
    both = tiled.select(*names, F.lit(None).cast("binary").alias("sketch")).unionByName(
        drawn.select("bucket", "node", "sketch", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("key", "i", "j", "own", "n", "comp")])
    )

    def close(rows: list[tuple], held: dict, seen: set) -> list[tuple[int, int]]:
        i, j = rows[0][2], rows[0][3]
        if len({r[7] for r in rows}) < 2:
            return []
        words = _fold([held[r[5]] for r in rows])
        n, comp, side = (np.array([r[k] for r in rows], np.int64) for k in (6, 7, 4))
        out = []
        for k in range(len(rows)) if i == j else np.flatnonzero(side == i).tolist():
            rest = np.arange(k + 1, len(rows)) if i == j else np.flatnonzero(side == j)
            m = n[rest]
            rest = rest[(comp[rest] != comp[k]) & (n[k] * den >= m * num) & (m * den >= n[k] * num)]
            if not len(rest):
                continue
            apart = np.bitwise_count(words[rest] ^ words[k]).sum(axis=1, dtype=np.int64)
            rest = rest[apart * (den + num) <= (den - num) * (n[rest] + n[k])]
            if forest and len(rest):
                joined, one = np.unique(comp[rest], return_index=True)
                rest = rest[one]
                comp[np.isin(comp, joined)] = comp[k]
            for q in rest.tolist():
                pair = (min(rows[k][5], rows[q][5]), max(rows[k][5], rows[q][5]))
                if pair not in seen:
                    seen.add(pair)
                    out.append(pair)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, rows, seen = None, {}, [], set()
        make = lambda pairs: pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and row[:4] != rows[0][:4]:
                    out += close(rows, held, seen)
                    rows = []
                if row[0] != bucket:
                    bucket, held = row[0], {}
                if row[1] is None:
                    held[row[5]] = row[8]
                else:
                    rows.append(row)
            if out:
                yield make(out)
            if len(seen) > 300_000:
                seen.clear()  # pairs seen again are made distinct later
        if rows and (out := close(rows, held, seen)):
            yield make(out)

    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.select(*names, "sketch").repartition(parts, "bucket").sortWithinPartitions("bucket", F.col("key").isNotNull(), "key", "i", "j")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _still_mixed(ws: Workspace, met: DataFrame, comps: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """(key, node, n, comp) of the points ``met``, and (key, m, nb) of those with different components, one for each set of nodes."""
    small = comps.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    now = met.select("key", "node", "n").join(F.broadcast(comps) if small else comps, "node", "left")
    now = ws.save(now.select("key", "node", "n", F.coalesce("comp", "node").alias("comp")), f"{tag}-now")
    alike = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in range(2)]
    sums = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), *alike)
    one = sums.where("lo <> hi").groupBy("m", "x0", "x1").agg(F.min("key").alias("key"))
    blocks = ws.save(one.select("key", "m", F.ceil(F.col("m") / TILE).cast("int").alias("nb")), f"{tag}-blocks")
    return now, blocks


def similar_sets(ws: Workspace, docs: DataFrame, n: int, sets: DataFrame, num: int = 80, den: int = 100, split: int = SPLIT, fan: int = FAN) -> DataFrame:
    """(node, comp) of nodes with links: ``den`` * intersection >= ``num`` * union, over components.

    ``docs``: (_id, _row, _text); ``sets``: what ``sets_of`` gives of them.
    """
    met = ws.save(gathered(meeting_points(docs, n, frequency_table(sets), num, den, split)), "met")
    fits = lambda x, y: (F.col(x) * den >= F.col(y) * num) & (F.col(y) * den >= F.col(x) * num)
    drawn = only_ids(sets.where("sketch is not null").select("node", "n_shingles", "_row", "sketch"), met.select("node"), "node")
    drawn = drawn.groupBy("node").agg(F.first("n_shingles").alias("n"), F.min("_row").alias("_row"), F.first("sketch").alias("sketch"))
    sketches = ws.save(drawn, "sketches")

    def near(x: bytes, n: int, y: bytes, m: int) -> bool:
        return hamming(x, y) * (den + num) <= (den - num) * (n + m)

    def alike(x: bytes, n: int, y: bytes, m: int) -> bool:
        both = len(np.intersect1d(_unpack48(x), _unpack48(y), assume_unique=True))
        return den * both >= num * (n + m - both)

    def exact(close: DataFrame, tag: str) -> DataFrame:
        close = ws.save(close, f"{tag}-close")
        rows = only_ids(sketches.select("node", "_row"), close.select(F.col("a").alias("node")).union(close.select("b")), "node").select("_row")
        held = grams_of(only_ids(docs.select("_row", "_text"), rows, "_row"), n)
        links = ws.save(_checked(_joined(held.withColumnRenamed("grams", "x"), _sides(close, fan), "node"), alike), f"{tag}-links")
        ws.drop(f"{tag}-close")
        return links

    stars = met.where((F.col("node") != F.col("rep")) & fits("n", "rep_n")).select(F.col("rep").alias("a"), F.col("node").alias("b"))
    parts = met.where("salt >= 0 and node = rep").select("key", "rep", "rep_n")
    first = parts.groupBy("key").agg(F.min(F.struct("rep", "rep_n")).alias("first")).select("key", F.col("first.rep").alias("first"), F.col("first.rep_n").alias("first_n"))
    across = parts.join(first, "key").where((F.col("rep") != F.col("first")) & fits("rep_n", "first_n")).select(F.col("first").alias("a"), F.col("rep").alias("b"))
    stars = ws.save(stars.union(across).distinct(), "stars")
    links = exact(_checked(_joined(sketches.select("node", "n", F.col("sketch").alias("x")), _sides(stars, fan), "node"), near), "star")
    comps = connected_components(ws, links, "cc0")
    met = met.select("key", "node", "n")  # a node has one row in a point
    for tag, forest in (("forest", True), ("rest", False)):
        now, blocks = _still_mixed(ws, met, comps, tag)
        if blocks.isEmpty():
            break
        more = exact(_close_in_tiles(now, blocks, sketches, num, den, forest).distinct(), tag)
        # a point with one component keeps one; and of points with the same nodes one is enough
        met = ws.save(only_ids(now, blocks, "key").select("key", "node", "n"), f"{tag}-met")
        ws.drop(f"{tag}-now", f"{tag}-blocks")
        if not more.isEmpty():
            links = links.union(more)
            comps = connected_components(ws, links, f"cc-{tag}")
    ws.drop("met", "forest-met", "rest-met", "sketches", "stars")
    return comps


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT, fan: int = FAN) -> DataFrame:
    """id, n_shingles and component_id (the smallest id that links reach) of each row of ``docs``.

    ``split`` and ``fan`` say how hot points and nodes are dealt out; the results don't depend on them.
    """
    ws = Workspace(docs.sparkSession, "ngram-join")
    named = keyed(docs, id_col, text_col)
    sets = ws.save(sets_of(named, n), "sets")
    comps = similar_sets(ws, named, n, sets, num, den, split, fan)
    rows = sets.where("part is null").select("_id", "n_shingles", "node").join(comps, "node", "left")
    rows = ws.save(rows.select("_id", "n_shingles", F.coalesce("comp", "node").alias("comp")), "rows")
    ws.drop("sets")
    least = ws.save(rows.where("comp is not null").groupBy("comp").agg(F.min("_id").alias("least")), "least")
    return rows.join(least, "comp", "left").select(F.col("_id").alias(id_col), "n_shingles", F.coalesce("least", "_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but one of each group of near copies: the one with the smallest id stays.

    Rows without an id stay; so do repeated rows of the id that stays, less their repeats.
    """
    ws = Workspace(docs.sparkSession, "keep-one")
    found = jaccard_components(docs, n, num, den, id_col, text_col)
    gone = ws.save(found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "gone")
    return docs.join(gone.hint("merge"), id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
