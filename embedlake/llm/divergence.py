"""Operator 12: how the words of each source differ from those of its language, by integer-coded dictionaries.

One pass over the texts counts terms by language and source, and the documents that hold them; tasks hand on sums.
Counts are then dealt out in the order of language and term, as bytes. Each run of at most ``CHUNK`` kept terms is a
chunk: a sorted array of terms, in which a term's id is its place (found by ``searchsorted`` in the runs of its
rows), and for each source the counts under these ids. Chunks and ids keep the order of terms, so ties need no
strings. A chunk's counts become dense vectors, a row for each source of a block of some ``BLOCK`` sources;
differences of pairs of sources are summed by tiles (chunk and two blocks) and then over chunks, and each chunk
hands on the first ``top`` terms of each of its sources.

All numbers are whole: shares are billionths, worked out digit by digit where they would exceed 64 bits, and exact
for up to 9 * 10^15 terms of a language. Sums are by language and source of partial sums, so a hot source or
language is no single task's. The rows of one term, one for each source, are held together.

Cases: null text, language and source are empty; a document without terms still makes its group occur; ids don't
matter, so repeated rows count each; a language without kept terms has pairs of value 0 and no terms; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from embedlake.llm import _text as T
from embedlake.llm._work import Workspace, join_facts

#: Bytes of no term: all below 0x80 but letters.
BETWEEN = np.zeros(256, bool)
BETWEEN[:128] = True
BETWEEN[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
SLICE = 4 << 20
#: Terms and counts of a chunk at most (a single term may have more counts), and sources of a block, on average at most.
CHUNK, ENTRIES, BLOCK = 4096, 1 << 20, 128
#: Documents of a language that a kept term needs, the count that is added to all, and ranks of terms.
LEAST, ADDED, TOP = 30, 5, 50
UNIT = 1_000_000_000


def billionths(a: np.ndarray, d: np.ndarray | int) -> np.ndarray:
    """floor(10^9 * a / d), exact for 0 <= a <= d < 9 * 10^15."""
    a = np.asarray(a, np.int64)
    if not a.size or a.max() < 9 * UNIT:
        return a * UNIT // d
    out, rest = np.divmod(a, d)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, d)
        out = out * 1000 + digits
    return out


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, df, n): occurrences and documents of each term in each group; partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in T.slices(batch.column(2), SLICE):
                starts, ends, first = T.words(data, offsets, BETWEEN)
                if not len(starts):
                    continue
                letters = T.LOWER[data[~BETWEEN[data]]]
                bounds = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
                coded = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
                code, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
                row = np.repeat(np.arange(b - a), np.diff(first))
                key, times = np.unique(row * size + code, return_counts=True)
                lang, source = (batch.column(c).slice(a, b - a).dictionary_encode() for c in (0, 1))
                group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
                key = group[key // size] * size + key % size
                order = np.argsort(key, kind="stable")
                key, times = key[order], times[order]
                at = _runs(key)
                group, code = np.divmod(key[at], size)
                yield pa.RecordBatch.from_arrays(
                    [
                        lang.dictionary.take(pa.array(group // len(source.dictionary))), source.dictionary.take(pa.array(group % len(source.dictionary))), coded.dictionary.take(pa.array(code)),
                        pa.array(np.diff(np.append(at, len(key)))), pa.array(np.add.reduceat(times, at).astype(np.int64)),
                    ],
                    ["lang", "source", "term", "df", "n"],
                )

    parts = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, df bigint, n bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


#: A row for each chunk and block: its terms, their counts in the language, its sources with their sums, and (source, id, count) of each entry.
CELL = "lang string, chunk bigint, block int, terms array<string>, total binary, sources array<string>, sums array<bigint>, src binary, id binary, n binary"


def _encoded(counts: DataFrame, blocks: int, least: int) -> DataFrame:
    """Cells of all chunks, from counts in the order of language and term."""

    def flush(chunk: int, t: pa.Table) -> Iterator[pa.RecordBatch]:
        """``t``: whole terms of one language, in order."""
        terms = t.column("term").combine_chunks()
        code = terms.dictionary_encode()  # in order of appearance: sorted
        sorted_terms, ids = code.dictionary, code.indices.to_numpy().astype(np.int64)
        n, block = t.column("n").to_numpy(), t.column("block").to_numpy()
        total = np.zeros(len(sorted_terms), np.int64)
        np.add.at(total, ids, n)
        for b in range(blocks):
            own = np.flatnonzero(block == b)
            source = t.column("source").take(pa.array(own)).combine_chunks().dictionary_encode()
            if isinstance(source, pa.ChunkedArray):
                source = source.combine_chunks()
            src = source.indices.to_numpy().astype(np.int64)
            sums = np.zeros(len(source.dictionary), np.int64)
            np.add.at(sums, src, n[own])
            row = {
                "lang": t.column("lang")[0].as_py(), "chunk": chunk, "block": b, "terms": sorted_terms.to_pylist(), "total": total.tobytes(), "sources": source.dictionary.to_pylist(), "sums": sums.tolist(),
                "src": src.tobytes(), "id": ids[own].tobytes(), "n": n[own].tobytes(),
            }
            yield pa.RecordBatch.from_pylist([row], schema=kind)

    kind = pa.schema([
        ("lang", pa.string()), ("chunk", pa.int64()), ("block", pa.int32()), ("terms", pa.list_(pa.string())), ("total", pa.binary()), ("sources", pa.list_(pa.string())), ("sums", pa.list_(pa.int64())),
        ("src", pa.binary()), ("id", pa.binary()), ("n", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, open_, size, entries = TaskContext.get().partitionId() << 32, None, [], 0, 0

        def kept(t: pa.Table) -> Iterator[pa.RecordBatch]:
            """Takes in whole terms; hands out chunks that are full."""
            nonlocal number, open_, size, entries
            lang, term = (t.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lang", "term"))
            at = _runs(lang, term)
            width = np.diff(np.append(at, len(term)))
            good = np.add.reduceat(t.column("df").to_numpy(), at) >= least
            t = t.filter(pa.array(np.repeat(good, width)))
            lang, width = lang[at][good], width[good]
            k = done = 0
            while k < len(width):
                if open_ and (size >= CHUNK or entries + width[k] > ENTRIES or open_[0].column("lang")[0] != t.column("lang")[done]):
                    yield from flush(number, pa.concat_tables(open_))
                    number, open_, size, entries = number + 1, [], 0, 0
                to = k + 1  # as many terms of the language as fit; one at least
                most = entries + width[k]
                while to < len(width) and lang[to] == lang[k] and size + to - k < CHUNK and most + width[to] <= ENTRIES:
                    most += width[to]
                    to += 1
                n = int(width[k:to].sum())
                open_.append(t.slice(done, n))
                size, entries, done, k = size + to - k, entries + n, done + n, to

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            if not t.num_rows:
                continue
            last = t.slice(t.num_rows - 1)
            same = pc.and_(pc.equal(t.column("lang"), last.column("lang")[0]), pc.equal(t.column("term"), last.column("term")[0]))
            start = int(np.argmax(same.combine_chunks().to_numpy(zero_copy_only=False)))  # equal rows stand together
            if start:
                yield from kept(t.slice(0, start))
            held = t.slice(start)
        if held is not None and held.num_rows:
            yield from kept(held)
        if open_:
            yield from flush(number, pa.concat_tables(open_))

    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = counts.select("lang", "term", "source", "df", "n", F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int").alias("block"))
    return rows.repartitionByRange(n, "lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, CELL)


def _dense(row: dict) -> tuple[list[str], np.ndarray, np.ndarray]:
    """A cell's sources, their counts by id, and their shares in billionths."""
    names, v = [m["source"] for m in row["members"]], len(row["terms"])
    out = np.zeros((len(names), v), np.int64)
    if row["src"]:
        sources = sorted(range(len(row["sources"])), key=lambda k: row["sources"][k].encode())
        place = np.zeros(len(sources), np.int64)
        known = {s: k for k, s in enumerate(names)}
        place[sources] = [known[row["sources"][k]] for k in sources]
        src, ids, n = (np.frombuffer(row[c], np.int64) for c in ("src", "id", "n"))
        out[place[src], ids] = n
    below = np.array([m["n"] + ADDED * row["v"] for m in row["members"]], np.int64)[:, None]
    return names, out, 1 + billionths(out + ADDED, below) if v else out


def _tile(rows: list[dict]) -> tuple[list[str], list[str], list[int]]:
    """Sums of differences for pairs of sources of one block, or of two."""
    (names, _, p), *other = map(_dense, rows)
    left, right, value = [], [], []
    if not other:
        for i in range(len(names)):
            left += [names[i]] * (len(names) - i - 1)
            right += names[i + 1 :]
            value += np.abs(p[i + 1 :] - p[i]).sum(axis=1).tolist()
    else:
        to, _, q = other[0]
        for i in range(len(names)):
            left += [names[i]] * len(to)
            right += to
            value += np.abs(q - p[i]).sum(axis=1).tolist()
    return left, right, value


PAIR = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])


def _pairs(cells: DataFrame, blocks: int) -> DataFrame:
    """(lang, a, b, value): parts of the sums of pairs, each pair once a chunk."""

    def made(rows: list[dict]) -> pa.RecordBatch:
        left, right, value = _tile(rows)
        return pa.RecordBatch.from_arrays([pa.array([rows[0]["lang"]] * len(left), pa.string()), pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(value, pa.int64())], schema=PAIR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield made(batch.slice(k, 1).to_pylist())

    def tile(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([made(sorted(t.to_pylist(), key=lambda r: r["block"]))])

    kind = "lang string, a string, b string, value bigint"
    if blocks == 1:
        return cells.mapInArrow(run, kind)
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    dealt = cells.select("*", other).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    return dealt.groupBy("lang", "chunk", "lo", "hi").applyInArrow(tile, kind)


def _tops(cells: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value): the first terms of each source in each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                names, n, p = _dense(row)
                q = 1 + billionths(np.frombuffer(row["total"], np.int64) + ADDED, row["n_lang"] + ADDED * row["v"])
                source, item, value = [], [], []
                for i, name in enumerate(names):
                    over = np.flatnonzero((n[i] > 0) & (p[i] > q))
                    f = (p[i] - q)[over]
                    best = np.lexsort((over, -f))[:top]  # ids are in the order of terms
                    source += [name] * len(best)
                    item += [row["terms"][j] for j in over[best]]
                    value += f[best].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(source), pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "item", "value"])

    return cells.mapInArrow(run, "lang string, source string, item string, value bigint")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank.

    Pairs: every other source of the language by the summed difference of shares. Terms: those that the source has
    more of than its language, to rank ``top``.
    """
    ws = Workspace(docs.sparkSession, "divergence")
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = ws.save(_counted(read), "counts")
    groups = ws.save(read.select("lang", "source").distinct(), "groups")
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    blocks = -(-most // BLOCK)
    cells = ws.save(_encoded(counts, blocks, least), "cells")
    ws.drop("counts")
    sums = cells.select("lang", F.inline(F.arrays_zip("sources", "sums"))).groupBy("lang", "sources").agg(F.sum("sums").alias("n"))
    sizes = cells.groupBy("lang").agg(F.sum(F.when(F.col("block") == 0, F.size("terms")).otherwise(0)).alias("v"), F.sum(F.aggregate("sums", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n_lang"))
    known = groups.join(sums.withColumnRenamed("sources", "source"), ["lang", "source"], "left").select("lang", F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int").alias("block"), F.struct("source", F.coalesce("n", F.lit(0)).alias("n")).alias("m"))
    members = known.groupBy("lang", "block").agg(F.sort_array(F.collect_list("m")).alias("members")).join(sizes, "lang", "left").na.fill(0, ["v", "n_lang"])
    members = ws.save(members, "members")
    full = join_facts(cells, members, ["lang", "block"], F.col("chunk"), "inner", weight=BLOCK)
    # a chunk without terms, so that each pair has a sum
    empty = members.select("*", F.lit(-1).cast("bigint").alias("chunk"), *[F.array().cast(t).alias(c) for c, t in (("terms", "array<string>"), ("sources", "array<string>"), ("sums", "array<bigint>"))], *[F.lit(b"").alias(c) for c in ("total", "src", "id", "n")])
    half = _pairs(full.unionByName(empty), blocks).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = half.select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))), "value")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = [("pair", pairs.withColumn("rank", rank)), ("term", _tops(full, top).withColumn("rank", rank).where(F.col("rank") <= top))]
    a, b = (df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, df in out)
    return a.unionAll(b)
