"""Operator 4: removal of repeated passages by prefix-partitioned suffix arrays.

Suffixes of all texts are split by prefixes of their words into groups that fit in memory. The first prefix has
``prefix`` words and is taken at anchors: the suffixes at which a window of ``window`` words has its smallest
``prefix``-word gram, one in six or so. Equal windows have their anchor at the same place, so none is lost, and
a prefix that stands only once ends there. Where it stands again, the words around the anchor, up to a window to
either side, go to the group of their prefix. In a group suffixes are brought into the order of their words by
prefix doubling (ranks of 1, 2, 4, ... words), down to ``window`` words; suffixes of equal rank are the leaves below one
deep internal node. Read along a text, they are the maximal repeats. The earliest leaf of a node stays; words
under any other are removed.

Anchors are counted by prefix first. A prefix with more than ``most`` anchors is prolonged to all ``window`` words:
each of its windows goes by a 128-bit digest of its words, which is a deep node itself, so an aggregate that sums
before it shuffles finds the earliest leaf, and leaves meet it by digest and salt. No task gets a hot prefix whole.
Which prefixes are hot travels as a set of 2^23 bits; one taken for hot by mistake only takes the longer way.

Groups compare words themselves: anchors' rows carry text, and words get exact numbers in a group. Hashes only deal
rows out; windows that a row has twice are found by hashes and compared by their words. Anchors that a task finds
repeated among its own rows are known to be so without a shuffle; a hot passage sends one row a slice of texts.
Texts are dealt out once, by row, and read again from there; what a row repeats itself is settled within the row.

Cases: null or empty text has no words; texts shorter than a window stay; rows without an id come last in
the order of documents; rows that repeat an id are documents at the same place, of which none removes the
other at the same start; an empty table gives no rows. Only id and text are read for the search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlake.llm import _text as T
from embedlake.llm._work import Workspace, bounded_ids, join_facts

SLICE = 3 << 20
PREFIX = 10
#: Anchors of a group at most, with 30 words or so each; and of the groups that are sorted at once.
MOST, TOGETHER = 50_000, 20_000
#: Windows that one anchor's row holds at most: a bit each.
RUN = 32
#: Bits of the set of hot prefixes.
HOT = 1 << 23


def doubled(ids: np.ndarray, left: np.ndarray, size: int) -> np.ndarray:
    """Ranks of the suffixes that start at each word, by their first ``size`` words: equal if and only if these are.

    ``left``: words from there to the end of the row; a row's end comes before all words.
    """
    rank, have, n = ids.astype(np.int64) + 1, 1, len(ids)
    at = np.arange(n)
    while have < size:
        step = min(have, size - have)  # two overlapping halves at the end
        behind = np.where(left > step, rank[np.minimum(at + step, n - 1)], 0)
        key = rank * (int(rank.max()) + 1) + behind
        order = np.argsort(key, kind="stable")
        new = np.append(True, key[order][1:] != key[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        have += step
    return rank


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, between: np.ndarray = T.SPACE) -> np.ndarray:
    """Numbers of all words of ``data``, equal if and only if the words are."""
    bounds = np.append(0, np.cumsum(ends - starts))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[~between[data]])])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def _gathered(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of ``data`` one behind the other, and their bounds."""
    ends = np.cumsum(size)
    at = np.repeat(begin - (ends - size), size)
    at += np.arange(len(at))
    return data[at], np.append(0, ends)


class Layout:
    """Words, windows and anchors of a run of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, prefix: int, bits: int = 64):
        self.data, self.window = data, window
        self.starts, self.ends, self.first = T.words(data, offsets)
        self.h = T.hashes(data, self.starts, self.ends) >> np.uint64(64 - bits)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        n = len(self.h)
        if n < window:
            self.at = self.anchor = self.anchors = np.zeros(0, np.int64)
            self.g, self.repeats = np.zeros(0, np.uint64), np.zeros(0, bool)
            return
        self.at = np.flatnonzero(self.row[: n - window + 1] == self.row[window - 1 :])  # where windows start
        g = T.grams(self.h, prefix)
        span, size = window - prefix + 1, 1
        best = np.arange(len(g))
        while size * 2 <= span:  # the leftmost smallest gram of spans that double
            left, right = best[:-size], best[size:]
            best = np.where(g[left] <= g[right], left, right)
            size *= 2
        left, right = best[: len(best) - (span - size)], best[span - size :]
        best = np.where(g[left] <= g[right], left, right)
        self.anchor = best[self.at]
        self.anchors = self.anchor[np.append(True, self.anchor[1:] != self.anchor[:-1])] if len(self.anchor) else self.anchor
        # an anchor at the seam of two rows cannot occur: windows lie within rows
        self.g = g[self.anchors]
        order = np.lexsort((self.g, self.row[self.anchors]))
        k, r = self.g[order], self.row[self.anchors][order]
        new = np.append(True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])) if len(k) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        times = np.diff(np.append(begin, len(k)))
        self.firsts, self.times = order[begin], times  # the first anchor of each gram in its row
        self.repeats = np.zeros(len(k), bool)
        self.repeats[order] = np.repeat(times > 1, times)

    def windows(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, anchors and hashes of the windows whose anchor is wanted (a flag for each anchor)."""
        mark = np.zeros(len(self.h) + 1, bool)
        mark[self.anchors[wanted]] = True
        take = mark[self.anchor]
        at = self.at[take]
        return at, self.anchor[take], T.grams(self.h, self.window)[at] if len(at) else np.zeros(0, np.uint64)

    def later(self, at: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Flags the windows whose words start earlier in the same row; windows of equal ``key`` are compared by their words."""
        out = np.zeros(len(at), bool)
        order = np.lexsort((key, self.row[at]))
        k, r, place = key[order], self.row[at][order], at[order]
        again = np.append(False, (k[1:] == k[:-1]) & (r[1:] == r[:-1])) if len(k) else out
        if not again.any():
            return out
        ids = word_ids(self.data, self.starts, self.ends)
        one, two = place[again], place[np.flatnonzero(again) - 1]
        if all(np.array_equal(ids[one + j], ids[two + j]) for j in range(self.window)):
            out[order] = again
            return out
        rank = doubled(ids, self.first[self.row + 1] - np.arange(len(ids)), self.window)[at]
        order = np.lexsort((rank, self.row[at]))
        k, r = rank[order], self.row[at][order]
        out[order] = np.append(False, (k[1:] == k[:-1]) & (r[1:] == r[:-1]))
        return out

    def texts(self) -> tuple[np.ndarray, np.ndarray]:
        """All words with a blank behind each, and where each starts."""
        size = self.ends - self.starts + 1
        raw, bounds = _gathered(np.append(self.data, np.uint8(32)), self.starts, size)
        raw[bounds[1:] - 1] = 32
        return raw, bounds

    def digests(self, at: np.ndarray) -> list[bytes]:
        """A digest of the words of each window."""
        raw, bounds = self.texts()
        whole, begin, end = raw.tobytes(), bounds[at].tolist(), bounds[at + self.window].tolist()
        return [hashlib.sha256(whole[a:b]).digest()[:16] for a, b in zip(begin, end, strict=True)]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of all entries of a list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), size), flat.astype(np.int64)


def _first_level(texts: DataFrame, window: int, prefix: int, bits: int) -> DataFrame:
    """(g, _row, p, m, told): the first anchor of each gram in each row, and how often the row has it.

    Of rows of a slice that share a gram, one stands for them with all their occurrences; a row each with ``told``
    says that its anchor repeats, under a number that deals such rows out evenly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in T.slices(batch.column(1), SLICE):
                x = Layout(data, offsets, window, prefix, bits)
                if not len(x.anchors):
                    continue
                order = np.argsort(x.g[x.firsts], kind="stable")
                at, times, g = x.anchors[x.firsts][order], x.times[order], x.g[x.firsts][order]
                begin = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                rows = np.diff(np.append(begin, len(g)))
                told = np.flatnonzero((np.repeat(rows, rows) > 1) & (times == 1))
                at_all, own = np.append(at[begin], at[told]), x.row
                columns = [
                    pa.array(np.append(g[begin], T.mix(g[told] ^ T.mix(at[told].astype(np.uint64)))).view(np.int64)), batch.column(0).take(pa.array(a + own[at_all])),
                    pa.array((at_all - x.first[own[at_all]]).astype(np.int32)), pa.array(np.append(np.add.reduceat(times, begin), times[told]).astype(np.int32)),
                    pa.array(np.append(np.zeros(len(begin), bool), np.ones(len(told), bool))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["g", "_row", "p", "m", "told"])

    return texts.select("_row", "_text").mapInArrow(run, "g bigint, _row bigint, p int, m int, told boolean")


def _repeated(first: DataFrame, most: int) -> DataFrame:
    """(_row, p, hot) of the anchors that other rows have too; and a row each with the gram ``hot`` that has more than ``most``.

    A stream over sorted rows that keeps one row between batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(row: np.ndarray, p: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
            n, m = len(row), len(hot)
            return pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(row, pa.int64()), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.array(p.astype(np.int32)), pa.nulls(m, pa.int32())]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(hot, pa.int64())]),
            ], ["_row", "p", "hot"])

        none = np.zeros(0, np.int64)
        held = None  # the last gram, its only row so far if that isn't out, and its anchors so far
        for batch in batches:
            told = batch.column(4).to_numpy(zero_copy_only=False)
            g, row, p, m = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:4])
            if told.any():
                yield made(row[told], p[told], none)
            g, row, p, m = g[~told], row[~told], p[~told], m[~told].astype(np.int64)
            if not len(g):
                continue
            count = m.copy()
            if held is not None:
                g, row, p, m, count = np.append(held[0], g), np.append(held[1], row), np.append(held[2], p), np.append(held[3], m), np.append(held[4], count)
            begin = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            size, total = np.diff(np.append(begin, len(g))), np.add.reduceat(count, begin)
            # m = 0: a row that goes on from the batch before, out already
            again = (np.repeat(size, size) > 1) & (m == 1)
            hot = g[begin[:-1]][total[:-1] > most]
            if again.any() or len(hot):
                yield made(row[again], p[again], hot)
            last = len(g) - 1
            held = (g[last:], row[last:], p[last], 0 if size[-1] > 1 else m[last], total[-1])
        if held is not None and held[4] > most:
            yield made(none, none, held[0])

    n = int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return first.repartition(n, "g").sortWithinPartitions("g").mapInArrow(run, "_row bigint, p int, hot bigint")


def _slot(g: np.ndarray) -> np.ndarray:
    """A gram's bit in the set of hot ones."""
    return (g.view(np.uint64) if g.dtype != np.uint64 else g) % np.uint64(HOT)


def _suffixes(joined: DataFrame, id_type: str, window: int, prefix: int, bits: int, hot: bytes) -> DataFrame:
    """(g, _row, _id, s, live, words): the words under the windows of each anchor that repeats.

    ``s`` is the first window's start; bit j of ``live`` is set if the window at s + j is the row's first of its text.
    Windows of hot grams have a row each; their ``words`` is a digest, and ``g`` is null.
    """
    shared = joined.sparkSession.sparkContext.broadcast(hot) if hot else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(shared.value, np.uint8) if shared is not None else None
        for batch in batches:
            for a, b, data, offsets in T.slices(batch.column(2), SLICE):
                x = Layout(data, offsets, window, prefix, bits)
                if not len(x.anchors):
                    continue
                row, p = _lists(batch.column(3).slice(a, b - a))
                known = np.zeros(len(x.h) + 1, bool)
                known[x.first[row] + p] = True
                at, anchor, key = x.windows(x.repeats | known[x.anchors])
                if not len(at):
                    continue
                g = T.grams(x.h, prefix)
                keep = ~x.later(at, key)
                if often is not None:
                    slot = _slot(g[anchor])
                    long = (often[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    own = at[long & keep]
                    if len(own):
                        take = pa.array(a + x.row[own])
                        s, n = pa.array((own - x.first[x.row[own]]).astype(np.int32)), len(own)
                        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), batch.column(0).take(take), batch.column(1).take(take), s, pa.array(np.ones(n, np.int64)), pa.array(x.digests(own), pa.binary())], ["g", "_row", "_id", "s", "live", "words"])
                    at, anchor, keep = at[~long], anchor[~long], keep[~long]
                    if not len(at):
                        continue
                new = np.append(True, anchor[1:] != anchor[:-1])
                begin = np.flatnonzero(new)
                place = np.arange(len(at)) - begin[np.cumsum(new) - 1]
                begin = np.flatnonzero(place % RUN == 0)
                group = np.cumsum(place % RUN == 0) - 1
                live = np.zeros(len(begin), np.int64)
                np.add.at(live, group[keep], np.int64(1) << (place[keep] % RUN))
                size = np.diff(np.append(begin, len(at))) + window - 1
                some = live > 0
                begin, size, live = begin[some], size[some], live[some]
                s = at[begin]
                raw, start = x.texts()
                text, bounds = _gathered(raw, start[s], start[s + size] - start[s] - 1)
                words = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(text)])
                take = pa.array(a + x.row[s])
                columns = [pa.array(g[anchor[begin]].view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array((s - x.first[x.row[s]]).astype(np.int32)), pa.array(live), words]
                yield pa.RecordBatch.from_arrays(columns, ["g", "_row", "_id", "s", "live", "words"])

    return joined.select("_row", "_id", "_text", "_at").mapInArrow(run, f"g bigint, _row bigint, _id {id_type}, s int, live bigint, words binary")


def deep_nodes(rank: np.ndarray, s: np.ndarray, live: np.ndarray, words: pa.Array, window: int) -> np.ndarray:
    """For each anchor's row the bits of its windows that are not the earliest leaf of their deep node.

    Rows are of whole groups; ``rank`` orders documents; ``words`` are texts of words with one blank between.
    """
    raw, bounds = T.buffers(words)
    data, offsets = raw[bounds[0] : bounds[-1]], bounds - bounds[0]
    starts, ends, first = T.words(data, offsets)
    size = np.diff(first)
    many = size - window + 1
    own = np.repeat(np.arange(len(s)), many)
    j = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
    alive = (live[own] >> j) & 1 > 0
    own, j = own[alive], j[alive]
    node = doubled(word_ids(data, starts, ends), np.repeat(first[1:], size) - np.arange(len(starts)), window)[first[own] + j]
    order = np.lexsort((s[own] + j, rank[own], node))
    own, j, node = own[order], j[order], node[order]
    same = np.append(False, node[1:] == node[:-1])
    lead = np.flatnonzero(~same)[np.cumsum(~same) - 1]  # the earliest leaf of the node
    behind = (rank[own] != rank[own[lead]]) | (s[own] + j != s[own[lead]] + j[lead])
    out = np.zeros(len(s), np.int64)
    np.add.at(out, own[behind], np.int64(1) << j[behind])
    return out


def _groups(suffixes: DataFrame, id_type: str, window: int) -> DataFrame:
    """(_row, _id, s, mask): windows that are not the earliest of their words, from a stream of whole groups."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        rank = pc.rank(t.column("_id").combine_chunks(), sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
        mask = deep_nodes(rank, t.column("s").to_numpy().astype(np.int64), t.column("live").to_numpy(), t.column("words").combine_chunks(), window)
        some = np.flatnonzero(mask)
        t = t.select(["_row", "_id", "s"]).take(pa.array(some)).append_column("mask", pa.array(mask[some]))
        return t.combine_chunks().to_batches(max_chunksize=max(1, len(some)))[0] if len(some) else pa.RecordBatch.from_pylist([], schema=t.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0  # rows of groups that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < TOGETHER:
                continue
            t = pa.Table.from_batches(held)
            g = t.column("g").to_numpy()
            open_at = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0
            if open_at:
                yield solve(t.slice(0, open_at))
                t = t.slice(open_at)
            held, n = t.to_batches(), t.num_rows
        if n:
            yield solve(pa.Table.from_batches(held))

    n = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return suffixes.repartition(n, "g").sortWithinPartitions("g").mapInArrow(run, f"_row bigint, _id {id_type}, s int, mask bigint")


def _by_whole_window(ws: Workspace, each: DataFrame) -> DataFrame:
    """(_row, _id, s, mask) of the repeats among windows of hot prefixes, a row each; ``words`` is the digest of all their words."""
    each = each.withColumn("place", F.struct(F.col("_id").isNull(), "_id", "s"))
    first = ws.save(each.groupBy("words").agg(F.min("place").alias("first")), "earliest")
    found = join_facts(each, first, ["words"], F.xxhash64("_row", "s"), "inner")
    return found.where("place > first").select("_row", "_id", "s", F.lit(1).cast("long").alias("mask"))


def _covered(x: Layout, flagged: np.ndarray, window: int) -> np.ndarray:
    """Flags the words under flagged windows."""
    step = np.zeros(len(x.h) + window + 1, np.int64)
    np.add.at(step, flagged, 1)
    np.add.at(step, flagged + window, -1)
    return np.cumsum(step)[: len(x.h)] > 0


def _searched(docs: DataFrame, id_col: str, text_col: str, window: int, prefix: int, most: int, bits: int) -> DataFrame:
    """The rows of ``docs`` with _row, _id, _text and ``_flagged``, the starts of windows that another row has earlier and their bits."""
    ws, n = Workspace(docs.sparkSession, "substring"), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select(
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)] or [F.lit(0)]).alias("_rest"),
    )
    kind = docs.schema[id_col].dataType.simpleString()
    dealt = named.repartition(n, "_row")
    repeated = ws.save(_repeated(_first_level(named, window, prefix, bits), most), "repeated")
    grams = repeated.where("hot is not null")
    hot = b"" if grams.isEmpty() else bytes(bounded_ids(grams, "hot", HOT, lambda c: F.pmod(F.col(c), F.lit(HOT))))
    known = repeated.where("hot is null").groupBy("_row").agg(F.collect_list("p").alias("_at"))
    suffixes = _suffixes(dealt.join(known, "_row", "left"), kind, window, prefix, bits, hot)
    if hot:
        suffixes = ws.save(suffixes, "suffixes")
        found = _groups(suffixes.where("g is not null"), kind, window).unionByName(_by_whole_window(ws, suffixes.where("g is null")))
    else:
        found = _groups(suffixes, kind, window)
    found = ws.save(found, "found")
    ws.drop("repeated", "suffixes", "earliest")
    # joined by row number alone, so that texts stay where they are dealt; two rows that share a number differ in id
    flags = found.groupBy("_row").agg(F.collect_list(F.struct(F.col("_id").alias("of"), "s", "mask")).alias("_all"))
    own = F.transform(F.filter("_all", lambda x: x["of"].eqNullSafe(F.col("_id"))), lambda x: F.struct(x["s"].alias("s"), x["mask"].alias("mask")))
    return dealt.join(flags, "_row", "left").withColumn("_flagged", own).drop("_all")


def _starts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and start of all windows of a column of lists of (s, mask)."""
    flat = column.flatten()
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    row, s, mask = np.repeat(np.arange(len(column)), size), flat.field("s").to_numpy(zero_copy_only=False), flat.field("mask").to_numpy(zero_copy_only=False)
    which, j = np.nonzero((mask[:, None] >> np.arange(RUN)) & 1)
    return row[which], s[which].astype(np.int64) + j


def _apply(docs: DataFrame, id_col: str, text_col: str, window: int, prefix: int, full: bool, counts: tuple[str, str] = ("", ""), most: int = MOST, bits: int = 64) -> DataFrame:
    found = _searched(docs, id_col, text_col, window, prefix, most, bits)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = f"_id {kinds[id_col]}, n_words bigint, n_removed bigint, " + ("kept_text string" if full else "kept_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in T.slices(batch.column(1), SLICE):
                x = Layout(data, offsets, window, prefix, bits)
                row, s = _starts(batch.column(2).slice(a, b - a))
                flagged = x.first[row] + s
                if len(x.anchors):
                    at, _, key = x.windows(x.repeats)
                    flagged = np.append(flagged, at[x.later(at, key)])
                gone = _covered(x, flagged, window)
                run_ = np.append(0, np.cumsum(gone))
                n_gone = run_[x.first[1:]] - run_[x.first[:-1]]
                out, raw, keep = [], data.tobytes(), (~gone).tolist()
                for k in range(b - a):
                    own, (lo, hi) = raw[offsets[k] : offsets[k + 1]], (int(x.first[k]), int(x.first[k + 1]))
                    if full and not n_gone[k]:
                        out.append(own.decode())
                        continue
                    words = own.split()
                    kept = b" ".join(compress(words, keep[lo:hi]) if n_gone[k] else words)
                    out.append(kept.decode() if full else hashlib.sha256(kept).hexdigest())
                columns = [batch.column(0).slice(a, b - a), pa.array(np.diff(x.first)), pa.array(n_gone), pa.array(out, pa.string())]
                names = ["_id", "n_words", "n_removed", "kept_text" if full else "kept_sha256"]
                if full:
                    columns.append(batch.column(3).slice(a, b - a))
                    names.append("_rest")
                yield pa.RecordBatch.from_arrays(columns, names)

    if not full:
        return found.select("_id", "_text", "_flagged").mapInArrow(run, schema).withColumnRenamed("_id", id_col)
    rest_type = found.schema["_rest"].dataType.simpleString()
    whole = found.select("_id", "_text", "_flagged", "_rest").mapInArrow(run, f"{schema}, _rest {rest_type}")
    named = {id_col: F.col("_id"), text_col: F.col("kept_text")}
    return whole.select(*[named.get(c, F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns], F.col("n_words").alias(counts[0]), F.col("n_removed").alias(counts[1]))


def removal_report(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, most: int = MOST, bits: int = 64) -> DataFrame:
    """id, n_words, n_removed and kept_sha256 (of the kept words, joined by one blank) of each row.

    ``most``: anchors of a group in memory; ``bits``: of the words' hashes by which rows are dealt out (fewer only cost time).
    """
    return _apply(docs, id_col, text_col, window, prefix, False, most=most, bits=bits)


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, counts: tuple[str, str] = ("_n_words", "_n_removed")) -> DataFrame:
    """``docs`` with the kept words as text, and the numbers of words and of removed ones under the names ``counts``.

    Texts that lose nothing stay as they are; a null text that does is empty.
    """
    return _apply(docs, id_col, text_col, window, prefix, True, counts)
