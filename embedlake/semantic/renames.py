"""Renamed relations and columns, found by what their columns are called, typed and filled with.

A snapshot has a row a column: its name, type, place and a sketch, the smallest of its values' hashes under each of some seeds
(minima, so parts' sketches merge, and one pass over a table gives those of all its columns). Two columns of like values
agree in as many of these as their values are alike.

What only one vanished and one new thing have in common speaks for the pair; what several share speaks for none. A pair is a
rename if on both sides nothing else has as much that speaks for it, and that is a quarter at least of what the vanished one
has. So no pairs are listed but those that something speaks for, and each of the steps is an aggregate. A vanished thing of which new
ones have a half, without such a pair, is ambiguous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Seeds of a sketch, and the share of what a vanished thing has that has to speak for its new name.
SEEDS, LEAST = 16, 0.25
SNAPSHOT = "schema_name string, name string, pos int, column_name string, type string, sketch array<long>"


def _hash(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    value = F.to_json(F.struct(c.alias("v"))) if "map<" in df.schema[name].dataType.simpleString() else c
    return F.when(c.isNotNull(), F.xxhash64(value))


def _sketches(df: DataFrame) -> DataFrame:
    """(pos, sketch) of the columns that have values."""
    cells = F.array(*[F.struct(F.lit(k).alias("pos"), _hash(df, n).alias("h")) for k, n in enumerate(df.columns)])
    rows = df.select(F.explode(cells).alias("c")).select("c.pos", "c.h").where("h is not null")
    return rows.groupBy("pos").agg(*[F.min(F.xxhash64(F.lit(k), "h")).alias(f"_{k}") for k in range(SEEDS)]).select("pos", F.array(*[f"_{k}" for k in range(SEEDS)]).alias("sketch"))


def snapshot(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """What relations look like; names as ``schema.name``. Columns without values have no sketch."""
    out = spark.createDataFrame([], SNAPSHOT)
    for full, df in tables.items():
        space, _, own = full.rpartition(".")
        heads = [(space or "default", own, k, f.name, f.dataType.simpleString()) for k, f in enumerate(df.schema)]
        columns = spark.createDataFrame(heads, "schema_name string, name string, pos int, column_name string, type string")
        out = out.unionByName(columns.join(_sketches(df), "pos", "left") if heads else columns.withColumn("sketch", F.lit(None).cast("array<long>")))
    return out


def _matches(evidence: DataFrame) -> DataFrame:
    """(scope, kind, old, new) from (scope, key, side, item), side 0 what has vanished and side 1 what is new."""
    evidence = evidence.distinct()
    old, new = F.when(F.col("side") == 0, F.col("item")), F.when(F.col("side") == 1, F.col("item"))
    by_key = evidence.groupBy("scope", "key").agg(F.min(old).alias("old"), F.max(old).alias("old2"), F.min(new).alias("new"), F.max(new).alias("new2"))
    votes = by_key.where("old = old2 and new = new2").groupBy("scope", "old", "new").agg(F.count("*").alias("n"))
    # how much a vanished thing has, and how much of it new ones have
    has = evidence.where("side = 0").join(by_key.select("scope", "key", F.col("new").isNotNull().alias("there")), ["scope", "key"])
    has = has.groupBy("scope", F.col("item").alias("old")).agg(F.count("*").alias("keys"), F.count_if("there").alias("shared"))
    for side in ("old", "new"):
        w = Window.partitionBy("scope", side)
        votes = votes.withColumn(f"_{side}", F.max("n").over(w))
    best = votes.where("n = _old and n = _new")
    for side in ("old", "new"):
        best = best.withColumn(f"_ties_{side}", F.count("*").over(Window.partitionBy("scope", side)))
    pairs = best.where("_ties_old = 1 and _ties_new = 1").join(has, ["scope", "old"]).where(F.col("n") >= LEAST * F.col("keys")).select("scope", "old", "new")
    found = has.join(pairs, ["scope", "old"], "left")
    kind = F.when(F.col("new").isNotNull(), "rename").when(2 * F.col("shared") >= F.col("keys"), "ambiguous")
    return found.withColumn("kind", kind).where("kind is not null").select("scope", "kind", "old", "new")


def _filled(c: Column) -> Column:
    return F.transform(F.coalesce(c, F.array().cast("array<long>")), lambda x, k: F.concat_ws(":", F.lit("v"), "type", k.cast("string"), x.cast("string")))


def _evidence(columns: DataFrame, scope: Column, item: Column, own: Column) -> DataFrame:
    """Keys of a column: those of its sketch, and one of its own."""
    return columns.select(scope.alias("scope"), "side", item.alias("item"), F.explode(F.concat(F.array(F.concat_ws(":", own, "type")), _filled(F.col("sketch")))).alias("key"))


def relations(vanished: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, old, new) for the relations of two snapshots; names as ``schema.name``."""
    both = vanished.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)))
    full = F.concat_ws(".", "schema_name", "name")
    return _matches(_evidence(both, F.lit(""), full, F.concat(F.lit("n:"), F.col("column_name")))).drop("scope")


def columns(before: DataFrame, after: DataFrame, pairs: DataFrame) -> DataFrame:
    """(relation, kind, old, new) for columns of relations, ``pairs`` (old, new) being the relations' names; ``relation`` is the new one.

    Columns whose names both sides have are the same.
    """
    full = F.concat_ws(".", "schema_name", "name")
    one = before.withColumn("_full", full).join(pairs.select(F.col("old").alias("_full"), F.col("new").alias("relation")), "_full").drop("_full").withColumn("side", F.lit(0))
    two = after.withColumn("_full", full).join(pairs.select(F.col("new").alias("_full"), F.col("new").alias("relation")), "_full").drop("_full").withColumn("side", F.lit(1))
    w = Window.partitionBy("relation", "column_name")
    other = one.unionByName(two).withColumn("_sides", F.count("*").over(w)).where("_sides = 1").drop("_sides")
    own = F.concat_ws(":", F.lit("p"), F.col("pos").cast("string"))
    return _matches(_evidence(other, F.col("relation"), F.col("column_name"), own)).withColumnRenamed("scope", "relation")
