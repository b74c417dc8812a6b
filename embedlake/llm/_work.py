"""Shared helpers: scratch tables in the cluster's shared folder, and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embedlake.session import shared_dir

def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until no column has it, in any case of letters."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


class Workspace:
    """Scratch Parquet tables. They survive the loss of executors and cut lineage."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/embedlake/{tag}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read again."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete scratch tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)


def bounded_ids(df: DataFrame, column: str, bits: int = 1 << 23, slot_of=None) -> bytearray:
    """A bit per hashed id of ``df``: a set membership filter of a fixed size (``bits`` / 8 bytes).

    False positives only let rows through to the exact join behind it, so the size never has to grow.
    """
    per = 32768
    slot = slot_of(column) if slot_of else F.pmod(F.xxhash64(column), F.lit(bits))
    rows = (
        df.select(slot.alias("slot"))
        .groupBy(F.floor(F.col("slot") / per).cast("long").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.col("slot") % per).alias("map"))
        .collect()
    )
    out = bytearray(bits // 8)
    for r in rows:
        at = r["bucket"] * (per // 8)
        out[at : at + per // 8] = r["map"]
    return out


#: Ids that are broadcast at most: 16 MB or so.
BROADCAST_IDS = 1_000_000


def only_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose ``column`` is in ``ids``: by broadcast if these are few, else by a shuffle of both."""
    ids = ids.select(column).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, column, "left_semi")


#: Rows of facts that are broadcast at most, and copies of each where they are not.
BROADCAST_FACTS, FACT_SALTS = 200_000, 16


def join_facts(rows: DataFrame, facts: DataFrame, on: list[str], spread: Column, how: str = "left", weight: int = 1) -> DataFrame:
    """``rows`` with what ``facts`` (a written table, a row for each key) has of their key.

    Few facts are broadcast; one counts for ``weight``. Else each is copied for every salt, and rows go by key and a salt from the hash
    ``spread``, so that a hot key's rows go to several tasks.
    """
    most = BROADCAST_FACTS // weight
    if facts.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(facts), on, how)
    salt = fresh("_salt", [*rows.columns, *facts.columns])
    copies = facts.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(FACT_SALTS - 1))))
    return rows.withColumn(salt, F.pmod(spread, F.lit(FACT_SALTS)).cast("int")).join(copies, [*on, salt], how).drop(salt)


def connected_components(ws: Workspace, edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, comp) for each node of ``edges`` (a, b); comp is the smallest node that links reach.

    Rounds of hooking to the smallest neighbour, pointer doubling and contraction. Every round is a few
    joins on even keys; neither links nor labels are gathered anywhere.
    """
    oriented = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = first = ws.save(oriented, f"{tag}-e0")
    hooks, k = [], 0

    def jump(near: DataFrame, far: DataFrame) -> DataFrame:
        """Each node's pointer, moved on by ``far`` where that has the node it points to."""
        far = far.select(F.col("node").alias("mid"), F.col("up").alias("top"))
        return near.join(far, F.col("up") == F.col("mid"), "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved"))

    while not live.isEmpty():
        hook = ws.save(live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), f"{tag}-h{k}-0")
        j = 0
        while True:
            twice = jump(hook, hook)
            far = ws.save(jump(twice, twice), f"{tag}-h{k}-{j + 1}")
            ws.drop(f"{tag}-h{k}-{j}")
            hook, j = far.select("node", "up"), j + 1
            if far.where("moved").isEmpty():
                break
        hooks.append(hook)
        step = live.join(hook.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a", "left").join(
            hook.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b", "left"
        )
        x, y = F.coalesce("ua", "a"), F.coalesce("ub", "b")
        live2 = ws.save(
            step.where(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct(),
            f"{tag}-e{k + 1}",
        )
        if k:
            ws.drop(f"{tag}-e{k}")
        live, k = live2, k + 1
    labels = first.select(F.col("a").alias("node")).union(first.select("b")).distinct().withColumn("up", F.col("node"))
    for hook in hooks:
        labels = jump(labels, hook).select("node", "up")
    return labels.withColumnRenamed("up", "comp") if not hooks else ws.save(labels.withColumnRenamed("up", "comp"), f"{tag}-labels")
