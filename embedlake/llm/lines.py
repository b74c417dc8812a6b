"""Operator 5: line dedup by a log-template tree.

Lines are parsed at a fixed depth: by token count, then by their first ``DEPTH`` tokens, with tokens that
hold digits generalised to ``<*>`` (lines that would be fields for the most part are kept as they are). Within a
leaf, a token that stands at its place in the forms of fewer than ``least`` documents (a document counts once for
each form that it has, however often) is a variable field and is generalised too, as long as half of the line
stays. Lines with one template recur when at least ``least`` documents have them, and either at least as many different neighbours are on
both sides, or at least as many of the documents differ in what stands beyond the line and the candidates
beside it. So headers, footers and banners of several lines recur, while lines of copied and nearly copied
documents are left to the operators for copies. Documents differ if fewer than ``ALIKE`` of ``MINS`` smallest
hashes of word pairs agree; a task keeps at most ``least`` different documents of a template.
A recurring template is dropped wherever it stands, but for its first place (smallest id, then line).

The first pass counts leaves; a filter of fixed size keeps the second pass to lines of leaves that can
recur, and only those lines move, as distinct masked lines with counts wherever possible. Groups are
aggregated before they move; texts move once, dealt by row.

Cases: null or empty text has no lines to drop; lines without a word stay and are nobody's neighbours; lines
of any length are generalised alike; rows without an id come last; repeated rows lose the same lines; an empty
table gives no rows. Only id and text are read for the search.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlake.llm import _text as T
from embedlake.llm._work import Workspace, bounded_ids, fresh

DEPTH, LEAST = 3, 8
SLICE = 2 << 20
MINS, ALIKE, HELD = 64, 28, 100_000
_MIX = np.random.default_rng(5).integers(1, 1 << 63, (2, MINS, 1), np.uint64) | np.uint64(1)
_DIGIT = re.compile(rb"[0-9]")


def _masked(tokens: list[bytes]) -> list[bytes]:
    """Tokens that hold a digit as fields."""
    return [b"<*>" if _DIGIT.search(t) else t for t in tokens]


def parse(text: bytes) -> list[tuple[int, int, list[bytes]]]:
    """(line number, leaf, tokens) of each line with a word."""
    import xxhash

    out = []
    for k, line in enumerate(text.split(b"\n")):
        tokens = line.split()
        if tokens:
            out.append((k, xxhash.xxh64_intdigest(b"%d " % len(tokens) + b" ".join(_masked(tokens[:DEPTH]))) >> 1, tokens))
    return out


def form(tokens: list[bytes]) -> list[bytes]:
    """A line with its fields masked; lines that would be fields for the most part are kept as they are."""
    masked = _masked(tokens)
    return masked if 2 * masked.count(b"<*>") <= len(masked) else tokens


def contents(lines: list[list[bytes]]) -> np.ndarray:
    """The smallest hashes of each line's word pairs, (line, MINS)."""
    words = np.fromiter((zlib.crc32(t) for tokens in lines for t in tokens), np.uint64)
    starts = np.cumsum([0, *(len(tokens) for tokens in lines[:-1])])
    after = np.append(words[1:], np.uint64(0))
    after[starts[1:] - 1] = 0
    pairs = words * np.uint64(0x9E3779B97F4A7C15) + after * np.uint64(0xC2B2AE3D27D4EB4F)
    pairs ^= pairs >> np.uint64(29)
    out, step = np.empty((len(lines), MINS), np.uint32), max(1, min(MINS, (1 << 20) // len(words)))
    for k in range(0, MINS, step):
        mixed = ((pairs[None, :] ^ _MIX[0, k : k + step]) * _MIX[1, k : k + step]) >> np.uint64(32)
        out[:, k : k + step] = np.minimum.reduceat(mixed, starts, axis=1).T
    return out


def beyond(lines: list[list[bytes]], held: list[bool]) -> list[bytes | None]:
    """For each held line, the content beyond the run of held lines it is in; of all lines if none are beyond."""
    each, n, out = contents(lines), len(lines), [None] * len(lines)
    before, behind = np.minimum.accumulate(each), np.minimum.accumulate(each[::-1])[::-1]
    a = 0
    while a < n:
        b = a + 1
        if held[a]:
            while b < n and held[b]:
                b += 1
            sides = [*([before[a - 1]] if a else []), *([behind[b]] if b < n else [])] or [before[-1]]
            out[a:b] = [np.minimum.reduce(sides).tobytes()] * (b - a)
        a = b
    return out


def _differs(kept: list[np.ndarray], content: np.ndarray) -> bool:
    return all(int((x == content).sum()) < ALIKE for x in kept)


def _leaves(named: DataFrame) -> DataFrame:
    """(leaf): once for each row that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in T.slices(batch.column(0), SLICE):
                raw = data.tobytes()
                found = [x for a, b in zip(offsets[:-1], offsets[1:], strict=True) for x in {p[1] for p in parse(raw[a:b])}]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["leaf"])

    return named.select("_text").mapInArrow(run, "leaf bigint")


def _lines(named: DataFrame, kind: str, wanted: bytes) -> DataFrame:
    """Lines whose leaf may recur: leaf, masked (its form's hash), prev, next (neighbours' hashes), tokens (once for each form of a row), _row, _id, line, content (beyond its run)."""
    bits = len(wanted) * 8

    def of(tokens: list[bytes]) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(b" ".join(tokens)) >> 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.frombuffer(wanted, np.uint8)
        for batch in batches:
            for at, _, data, offsets in T.slices(batch.column(2), SLICE):
                raw, rows = data.tobytes(), []
                for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    own = parse(raw[a:b])
                    held = [bool(keep[p[1] % bits >> 3] >> (p[1] % bits & 7) & 1) for p in own]
                    rest, had = beyond([p[2] for p in own], held) if any(held) else [], set()
                    for j, (line, leaf, tokens) in enumerate(own):
                        if held[j]:
                            tokens = form(tokens)
                            own_form = of(tokens)
                            text = None if (leaf, own_form) in had else b" ".join(tokens)
                            had.add((leaf, own_form))
                            rows.append((at + k, leaf, own_form, of(own[j - 1][2]) if j else 0, of(own[j + 1][2]) if j + 1 < len(own) else 0, text, line, rest[j]))
                c = list(zip(*rows, strict=True)) or [[]] * 8
                take = pa.array(c[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c[i], pa.int64()) for i in (1, 2, 3, 4)), pa.array([t.decode("utf-8", "replace") if t else None for t in c[5]], pa.string()), batch.column(0).take(take), batch.column(1).take(take), pa.array(c[6], pa.int32()), pa.array(c[7], pa.binary())],
                    ["leaf", "masked", "prev", "next", "tokens", "_row", "_id", "line", "content"],
                )

    return named.select("_row", "_id", "_text").mapInArrow(run, f"leaf bigint, masked bigint, prev bigint, next bigint, tokens string, _row bigint, _id {kind}, line int, content binary")


def _templates(ws: Workspace, lines: DataFrame, least: int) -> DataFrame:
    """(masked, template): fields that vary within a leaf are generalised."""
    distinct = ws.save(
        lines.where("tokens is not null").groupBy("leaf", "masked").agg(F.first("tokens").alias("tokens"), F.count("*").alias("n")), "distinct"
    )
    mixed = ws.save(distinct.groupBy("leaf").agg(F.count("*").alias("forms"), F.sum("n").alias("all")).where((F.col("forms") > 1) & (F.col("all") >= least)).select("leaf"), "mixed")
    tokens = distinct.join(mixed, "leaf").select("leaf", "masked", "n", F.posexplode(F.split("tokens", " ")).alias("pos", "token"))
    common = ws.save(tokens.groupBy("leaf", "pos", "token").agg(F.sum("n").alias("times")).where(F.col("times") >= least).drop("times"), "common")
    marked = tokens.join(common.withColumn("fixed", F.lit(True)), ["leaf", "pos", "token"], "left")
    field = F.struct("pos", F.when(F.col("fixed"), F.col("token")).otherwise("<*>").alias("token"))
    whole = marked.groupBy("leaf", "masked").agg(F.array_sort(F.collect_list(field)).alias("t"))
    kept = F.size(F.filter("t", lambda x: x["token"] != "<*>")) * 2 >= F.size("t")
    return whole.select("masked", F.when(kept, F.xxhash64("leaf", F.array_join(F.transform("t", lambda x: x["token"]), " "))).alias("template")).where("template is not null")


def _varied(placed: DataFrame, often: DataFrame, least: int) -> DataFrame:
    """(template): those of ``often`` in at least ``least`` documents of different contents."""

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[np.ndarray]] = {}

        def out() -> pa.RecordBatch:
            rows = [(t, c.tobytes()) for t, k in kept.items() for c in k]
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["template", "content"])

        for batch in batches:
            for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = kept.setdefault(t, [])
                if len(own) < least and _differs(own, x := np.frombuffer(c, np.uint32)):
                    own.append(x)
            if len(kept) > HELD:
                yield out()
        yield out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            found = []
            for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t != now:
                    now, own = t, []
                if len(own) < least and _differs(own, x := np.frombuffer(c, np.uint32)):
                    own.append(x)
                    if len(own) == least:
                        found.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["template"])

    kept = placed.select("template", "content").mapInArrow(few, "template bigint, content binary").join(often.select("template"), "template")
    return kept.repartition("template").sortWithinPartitions("template", "content").mapInArrow(count, "template bigint")


def recurring_lines(docs: DataFrame, ws: Workspace, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_row, _lines): the numbers of the lines that each row loses."""
    named = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    leaves = ws.save(_leaves(named).groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("leaf"), "leaves")
    bits = 1 << 23
    wanted = bytes(bounded_ids(leaves, "leaf", bits, lambda c: F.pmod(F.col(c), F.lit(bits))))
    lines = ws.save(_lines(named, docs.schema[id_col].dataType.simpleString(), wanted), "lines")
    forms = ws.save(_templates(ws, lines, least), "forms")
    placed = ws.save(lines.join(forms, "masked", "left").select(F.coalesce("template", "masked").alias("template"), "prev", "next", "_row", "_id", "line", "content"), "placed")

    def distinct(what: str) -> DataFrame:
        return placed.groupBy("template", what).agg(F.lit(1).alias("x")).groupBy("template").agg(F.count("*").alias(f"n_{what}")).where(F.col(f"n_{what}") >= least)

    first = placed.groupBy("template").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "line")).alias("first"), F.count("*").alias("n")).where(F.col("n") >= least)
    held = ws.save(first.join(distinct("_row"), "template").select("template", "first"), "held")
    between = distinct("prev").join(distinct("next"), "template").select("template")
    often = ws.save(held.join(between.unionByName(_varied(placed, held, least)).distinct(), "template"), "often")
    here = F.struct(F.col("_id").isNull(), "_id", "line")
    gone = ws.save(placed.join(often, "template").where(here > F.col("first")).groupBy("_row").agg(F.collect_set("line").alias("_lines")), "gone")
    ws.drop("leaves", "lines", "distinct", "mixed", "common", "forms", "placed", "held", "often")
    return gone


def _apply(docs: DataFrame, least: int, id_col: str, text_col: str, report: bool, counts: tuple[str, str] = ("", "")) -> DataFrame:
    ws = Workspace(docs.sparkSession, "lines")
    gone = recurring_lines(docs, ws, least, id_col, text_col)
    row, drops_col = fresh("_row", docs.columns), fresh("_lines", docs.columns)
    gone = gone.select(F.col("_row").alias(row), F.col("_lines").alias(drops_col))
    keyed = docs.withColumn(row, F.xxhash64(F.col(id_col), F.col(text_col))).join(gone.hint("merge"), row, "left")
    names = [id_col, text_col] if report else docs.columns
    at = names.index(text_col)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drops = batch.column(at), batch.column(len(names)).to_pylist()
            out, n_lines, n_gone, digest = [], [], [], []
            for text, drop in zip((x.as_py() for x in texts), drops, strict=True):
                lines = text.split("\n") if text else []
                if drop:
                    skip = set(drop)
                    text = "\n".join(x for k, x in enumerate(lines) if k not in skip)
                n_lines.append(len(lines))
                n_gone.append(len(drop or ()))
                if report:
                    digest.append(hashlib.sha256((text or "").encode()).hexdigest())
                else:
                    out.append(text)
            n = [pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64())]
            if report:
                yield pa.RecordBatch.from_arrays([batch.column(0), *n, pa.array(digest)], [id_col, "n_lines", "n_dropped", "kept_sha256"])
            else:
                columns = [*batch.columns[: len(names)], *n]
                columns[at] = pa.array(out, texts.type)
                yield pa.RecordBatch.from_arrays(columns, [*names, *counts])

    schema = f"`{id_col}` {kinds[id_col]}, n_lines bigint, n_dropped bigint, kept_sha256 string" if report else ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", `{counts[0]}` bigint, `{counts[1]}` bigint"
    return keyed.select(*[F.col(f"`{c}`") for c in names], drops_col).mapInArrow(run, schema)


def drop_report(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_lines, n_dropped and kept_sha256 (of the kept lines) of each row."""
    return _apply(docs, least, id_col, text_col, True)


def drop_recurring(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("_n_lines", "_n_dropped")) -> DataFrame:
    """``docs`` without recurring lines, and how many lines each row had and lost, under the names ``counts``."""
    return _apply(docs, least, id_col, text_col, False, counts)
