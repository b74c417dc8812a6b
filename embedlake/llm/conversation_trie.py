"""Operator 11: the prefix trie of conversations, by an external mergesort whose runs carry common prefixes.

Conversations are first rebuilt: an opening may be taken from another conversation (``rebuilt``). A turn is a
128-bit hash of role and text, so a conversation is a string of 16 bytes a turn; texts don't travel, their
lengths do. Equal conversations become one sequence with its smallest member, their number, and the digest of
their ids, which are joined by runs of 2^``IDS`` numbers before they move, so that many copies of one conversation are
a few long rows.

Sequences are dealt out by ranges, whose bounds come from the sequences with the smallest hashes (``SAMPLE`` a
range). In a range, runs are sorted and each sequence carries the number of turns that it shares with the one
before; a loser tree merges the runs and compares turns only beyond what both contenders share with the last
winner. Nodes stand on a stack, the path of the last sequence; those beyond the next one's common prefix are
finished and go out. A range also gets the last sequence before it, so each node is counted new once: figures of
nodes that several ranges see (its first and last path) are sums over ranges, all other rows are done as they are.

Cases: rows without an id are no conversation; null role and text are empty; turns at one place are ordered by
role, then by the hash of the turn; repeated rows are turns each; a conversation of no turns ends at the root;
an empty table gives no rows; other columns are not read. A conversation is held as one row of 20 bytes a turn.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from embedlake.llm._work import Workspace, join_facts

#: Bytes of a turn, bits of the ids of a run of ids, sequences of a sorted run, and bytes of a range, about.
TURN, IDS, RUN, RANGE = 16, 12, 4096, 16 << 20
#: Sequences for each range from which bounds are chosen, ranges at most (beyond, they grow), and bytes of a bound.
SAMPLE, RANGES, BOUND = 4, 100_000, 1024
#: A conversation opens with so many turns less one, at most, of the first one of its ``FAMILY``.
OPENINGS, FAMILY = 6, 100


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as structs of a hash and the text's length."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN))
    place = F.struct(F.col(turn_col).isNotNull().alias("known"), F.col(turn_col).alias("turn"), role.alias("role"), key.alias("key"), F.length(text).alias("chars"))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("bigint").alias("conv_id"), place.alias("place"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("place")).alias("all"))
    return listed.select("conv_id", F.transform("all", lambda t: F.struct(t["key"].alias("key"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(ws: Workspace, conversations: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, turns) of conversations that open with the first turns of another.

    c gets the first crc32(c) % ``OPENINGS`` turns of conversation c - c % ``FAMILY``, then its own beyond as many.
    """
    own = ws.save(turns(conversations, **columns), "turns")
    many = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENINGS).cast("int")
    heads = own.where(f"conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("head"), F.slice("turns", 1, OPENINGS - 1).alias("opening"))
    rows = own.withColumn("h", many).withColumn("head", F.expr(f"conv_id - conv_id % {FAMILY}")).join(heads, "head", "left")
    none = F.array().cast(own.schema["turns"].dataType)
    opening = F.when(F.col("h") > 0, F.slice(F.coalesce("opening", none), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(none)
    return rows.select("conv_id", F.concat(opening, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def sequences(rows: DataFrame) -> DataFrame:
    """(seq, chars, n, least, ends) of each distinct conversation of ``rows`` (conv_id, turns).

    seq: 16 bytes a turn; chars: lengths, 4 bytes each; ends: SHA-256 of the ids, ascending and joined by commas.
    """
    packed = rows.select("conv_id", F.expr("unhex(array_join(transform(turns, t -> hex(t.key)), ''))").alias("seq"), F.expr("unhex(array_join(transform(turns, t -> lpad(hex(t.chars), 8, '0')), ''))").alias("chars"))
    key = F.unhex(F.substring(F.sha2("seq", 256), 1, 2 * TURN))
    parts = packed.groupBy(key.alias("key"), F.shiftright("conv_id", IDS).alias("part")).agg(
        F.sort_array(F.collect_list("conv_id")).alias("ids"), F.first("seq").alias("seq"), F.first("chars").alias("chars"),
    ).select("key", "part", F.get("ids", F.lit(0)).alias("least"), F.size("ids").cast("bigint").alias("n"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "seq", "chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A stream in the order of key and part; only the digest of an open sequence is kept."""
        last = sha = head = None
        for batch in batches:
            out = []
            key, n, ids = (batch.column(c).to_pylist() for c in ("key", "n", "ids"))
            for k, own in enumerate(key):
                if own == last:
                    sha.update(b"," + ids[k].encode())
                    head["n"] += n[k]
                    continue
                if head is not None:
                    out.append(head | {"ends": sha.hexdigest()})
                last, sha = own, hashlib.sha256(ids[k].encode())
                head = {"seq": batch.column("seq")[k].as_py(), "chars": batch.column("chars")[k].as_py(), "n": n[k], "least": batch.column("least")[k].as_py()}
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=SEQUENCE)
        if head is not None:
            yield pa.RecordBatch.from_pylist([head | {"ends": sha.hexdigest()}], schema=SEQUENCE)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.repartition(n, "key").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(run, "seq binary, chars binary, n bigint, least bigint, ends string")


SEQUENCE = pa.schema([("seq", pa.binary()), ("chars", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())])


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that both open with; the first ``known`` are known to be."""
    n, at = min(len(a), len(b)) // TURN, known
    while at < n and a[at * TURN : (at + 1) * TURN] == b[at * TURN : (at + 1) * TURN]:
        at += 1
    return at


def merge(runs: list[list[tuple[bytes, int, object]]]) -> Iterator[tuple[bytes, int, object]]:
    """One sorted stream of (sequence, turns shared with the one before, what belongs to it) from sorted runs of such.

    A loser tree: each inner place keeps the loser of its match and how much it shares with the winner. Of two
    contenders, both measured against the last winner, the one that shares more is smaller; only at a tie are
    turns compared, from there on.
    """
    k = len(runs)
    if not k:
        return
    at, lcp = [0] * k, [0] * k

    def less(a: int, b: int) -> bool:
        """Whether run a's head comes first; the loser's shared turns are set to those with the winner."""
        if at[a] >= len(runs[a]) or at[b] >= len(runs[b]):
            return at[b] >= len(runs[b])
        if lcp[a] != lcp[b]:
            return lcp[a] > lcp[b]
        x, y = runs[a][at[a]][0], runs[b][at[b]][0]
        n = shared(x, y, lcp[a])
        first = x[n * TURN : (n + 1) * TURN] <= y[n * TURN : (n + 1) * TURN]
        lcp[b if first else a] = n
        return first

    loser = [-1] * k  # at 1 to k - 1; run r starts below place k + r

    def play(place: int) -> int:
        if place >= k:
            return place - k
        a, b = play(2 * place), play(2 * place + 1)
        won, loser[place] = (a, b) if less(a, b) else (b, a)
        return won

    best = play(1) if k > 1 else 0
    while at[best] < len(runs[best]):
        seq, _, own = runs[best][at[best]]
        yield seq, lcp[best], own
        at[best] += 1
        if at[best] < len(runs[best]):
            lcp[best] = runs[best][at[best]][1]
        place = (best + k) // 2
        while place:
            if less(loser[place], best):
                best, loser[place] = loser[place], best
            place //= 2


class _Node:
    """A node on the open path: figures of its subtree so far."""

    __slots__ = ("depth", "chars", "new", "n", "least", "children", "leaves", "saved", "ends", "kids", "edge")

    def __init__(self, depth: int, chars: int, new: bool):
        self.depth, self.chars, self.new, self.edge = depth, chars, new, False
        self.n = self.children = self.leaves = self.saved = 0
        self.least = self.ends = None
        self.kids: list[int] = []


#: id: of nodes that other ranges may see too; parent_id: of children of such, whose parent_conv_id isn't known here.
NODE = pa.schema([
    ("id", pa.binary()), ("parent_id", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()),
])


def nodes(merged: Iterator[tuple[bytes, int, tuple]], before: bytes | None, last: bool) -> list[dict]:
    """Rows of all nodes of sorted sequences; ``before`` is the last sequence of the range before, ``last`` says that none comes behind.

    What belongs to a sequence is (lengths, n, least, ends).
    """
    path, out = [], []
    seq = None

    def node_id(depth: int) -> bytes:
        return hashlib.sha256(seq[: depth * TURN]).digest()[:16]

    def close(depth: int) -> None:
        """Finish the open nodes below ``depth``; ``seq`` is the path they lie on."""
        while len(path) > depth:
            x = path.pop()
            row = {
                "id": node_id(x.depth) if x.edge else None, "parent_id": None, "depth": x.depth, "conv_id": x.least, "parent_conv_id": None,
                "n_convs": x.n, "n_children": x.children, "n_leaves": x.leaves, "saved_tokens": x.saved + x.n * x.chars - (x.chars if x.new else 0), "ends": x.ends,
            }
            if not x.edge:
                for kid in x.kids:
                    out[kid]["parent_conv_id"] = x.least
            elif x.kids:
                own = node_id(x.depth)
                for kid in x.kids:
                    out[kid]["parent_id"] = own
            if path:
                up = path[-1]
                if x.edge:
                    up.edge = True
                    row["parent_id"] = node_id(up.depth)
                else:
                    up.kids.append(len(out))
                up.n += x.n
                up.children += x.new
                up.leaves += x.leaves
                up.saved += row["saved_tokens"]
                if up.least is None or (x.least is not None and x.least < up.least):
                    up.least = x.least
            out.append(row)

    for own, common, (chars, n, least, ends) in merged:
        lengths = np.frombuffer(chars, ">u4")
        if seq is None:
            common = 0 if before is None else shared(own, before)
            path = [_Node(d, int(lengths[d - 1]) if d else 0, False) for d in range(common + 1)]
            path[0].new = before is None
            for x in path:
                x.edge = before is not None
            if before is not None and common == len(before) // TURN:
                path[-1].leaves -= 1  # it was taken for childless where it ended
        else:
            if common < len(seq) // TURN:
                path[-1].leaves += 1
            close(common + 1)
        seq = own
        for d in range(common + 1, len(lengths) + 1):
            path.append(_Node(d, int(lengths[d - 1]), True))
        x = path[-1]
        x.n, x.ends = x.n + n, ends
        x.least = least if x.least is None else min(x.least, least)
    if seq is not None:
        path[-1].leaves += 1
        for x in path:
            x.edge = x.edge or not last
        close(0)
    return out


def _range_nodes(key: tuple, table: pa.Table) -> pa.Table:
    """The nodes of one range; one row, without ``n``, has the last sequence of the range before, or none."""
    table = table.combine_chunks()
    mark = pc.is_null(table.column("n"))
    before = table.filter(mark).column("seq").to_pylist()
    last = True in table.filter(mark).column("last").to_pylist()
    table = table.filter(pc.invert(mark))
    runs = []
    for k in range(0, table.num_rows, RUN):
        cols = [table.column(c).slice(k, RUN).to_pylist() for c in ("seq", "chars", "n", "least", "ends")]
        rows = sorted(zip(*cols), key=lambda r: r[0])
        lcp = [0, *(shared(a[0], b[0]) for a, b in zip(rows, rows[1:]))]
        runs.append([(r[0], n, r[1:]) for r, n in zip(rows, lcp)])
    return pa.Table.from_pylist(nodes(merge(runs), before[0] if before else None, last), schema=NODE)


def _ranges(ws: Workspace, seqs: DataFrame) -> DataFrame:
    """``seqs`` with the number of its range, and for each range a row without n: the last sequence before it."""
    spark = seqs.sparkSession
    size, n = seqs.agg(F.sum(F.length("seq") * 2 + 150), F.count("*")).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = min(max(least, (size or 0) // RANGE), RANGES)
    # the sequences with the smallest hashes, the same whatever the order of rows
    sample = sorted(bytes(r[0]) for r in seqs.select(F.substring("seq", 1, BOUND).alias("s"), F.xxhash64("seq").alias("h")).orderBy("h").limit(many * SAMPLE).select("s").collect())
    bounds = sorted({sample[k * len(sample) // many] for k in range(1, many)}) if sample else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bisect.bisect_right(bounds, s) for s in batch.column("seq").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], [*batch.schema.names, "range"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seqs.schema)
    placed = ws.save(seqs.mapInArrow(place, f"{kind}, range int"), "placed")
    ends = ws.save(placed.groupBy("range").agg(F.max("seq").alias("seq")), "range-ends")
    numbers = sorted(r[0] for r in ends.select("range").collect())
    after = Y.StructType([Y.StructField("range", Y.IntegerType()), Y.StructField("next", Y.IntegerType())])
    follows = spark.createDataFrame(list(zip(numbers, numbers[1:])), after)
    before = ends.join(follows, "range").select("seq", F.col("next").alias("range"), F.lit(False).alias("last"))
    final = spark.createDataFrame([(numbers[-1],)] if numbers else [], "range int").select(F.lit(None).cast("binary").alias("seq"), "range", F.lit(True).alias("last"))
    return placed.withColumn("last", F.lit(False)).unionByName(before.unionByName(final), allowMissingColumns=True)


def trie(rows: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``rows`` (conv_id, turns), one for each conversation.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    ws = Workspace(rows.sparkSession, "trie")
    seqs = ws.save(sequences(rows), "sequences")
    found = ws.save(_ranges(ws, seqs).groupBy("range").applyInArrow(_range_nodes, Y.StructType([
        Y.StructField(f.name, {pa.binary(): Y.BinaryType(), pa.int64(): Y.LongType(), pa.string(): Y.StringType()}[f.type]) for f in NODE])), "nodes")
    ws.drop("sequences", "placed", "range-ends")
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    edges = found.where("id is not null").groupBy("id").agg(F.first("parent_id").alias("parent_id"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in sums], F.max("ends").alias("ends"))
    edges = ws.save(edges, "edges")
    tops = edges.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("top"))
    inner = found.where("id is null").drop("id")
    both = inner.unionByName(edges.drop("id"), allowMissingColumns=True)
    out = join_facts(both, tops, ["parent_id"], F.xxhash64("conv_id", "depth"))
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", F.coalesce("parent_conv_id", "top").alias("parent_conv_id"), *sums, F.coalesce("ends", F.lit(none)).alias("ends_sha256"))
