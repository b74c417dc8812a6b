"""Unique columns and references between tables, found by sketches first and checked exactly where these leave it open."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Relative error of the count sketches, with which a column may still be unique or lie within another.
ERROR = 0.02
#: Values that stand for a column before its exact check, out of one in so many by their hashes.
PROBES = 64
KINDS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.DateType, T.DecimalType)


@dataclass
class Profile:
    """What one pass over a table says of its columns."""

    df: DataFrame
    rows: int
    columns: dict[str, dict]
    probes: dict[str, list] = field(default_factory=dict)


def profile(df: DataFrame) -> Profile:
    """Counts, ranges and sketches of all columns that can be keys, in one aggregate."""
    names = [f.name for f in df.schema if isinstance(f.dataType, KINDS)]
    asked = [F.count("*").alias("rows")]
    for k, n in enumerate(names):
        c = F.col(f"`{n}`")
        asked += [F.approx_count_distinct(c, ERROR).alias(f"d{k}"), F.count(c).alias(f"n{k}"), F.min(c).alias(f"a{k}"), F.max(c).alias(f"z{k}")]
    r = df.agg(*asked).first()
    return Profile(df, r["rows"], {n: {"distinct": r[f"d{k}"], "values": r[f"n{k}"], "least": r[f"a{k}"], "most": r[f"z{k}"], "type": df.schema[n].dataType} for k, n in enumerate(names)})


def _repeats(df: DataFrame, name: str) -> bool:
    return not df.groupBy(F.col(f"`{name}`")).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def unique_columns(p: Profile) -> list[str]:
    """Columns without nulls in which no value stands twice; only those whose sketch allows it are grouped."""
    near = [n for n, c in p.columns.items() if p.rows and c["values"] == p.rows and c["distinct"] >= (1 - 3 * ERROR) * p.rows]
    return [n for n in near if not _repeats(p.df, n)]


def _within(a: Profile, x: str, b: Profile, y: str, unique: list[str]) -> bool:
    """Whether all values of column ``x`` are among those of ``y``: by types, ranges and counts, then some values, then all.

    ``unique``: columns of ``a`` in which no value stands twice.
    """
    one, two = a.columns[x], b.columns[y]
    if one["type"] != two["type"] or not one["values"] or not two["values"]:
        return False
    if one["least"] < two["least"] or one["most"] > two["most"] or one["distinct"] > (1 + 6 * ERROR) * two["distinct"]:
        return False
    mine, theirs = a.df.select(F.col(f"`{x}`").alias("v")).where("v is not null"), b.df.select(F.col(f"`{y}`").alias("v"))
    if x not in a.probes:
        a.probes[x] = [r[0] for r in mine.where(F.pmod(F.xxhash64("v"), F.lit(PROBES)) == 0).limit(PROBES).distinct().collect()]
    if a.probes[x] and theirs.where(F.col("v").isin(a.probes[x])).select("v").distinct().count() < len(a.probes[x]):
        return False
    return (mine if x in unique else mine.distinct()).join(theirs, "v", "left_anti").isEmpty()


def references(tables: dict[str, DataFrame]) -> list[tuple[str, str, str, str]]:
    """(table, column, other table, unique column) wherever all values of a column are those of a unique one of another table."""
    return found(tables)[1]


def found(tables: dict[str, DataFrame]) -> tuple[dict[str, list[str]], list[tuple[str, str, str, str]]]:
    """The unique columns of each table, and what ``references`` gives; each table is profiled and each column grouped once."""
    known = {n: profile(df) for n, df in tables.items()}
    unique = {n: unique_columns(p) for n, p in known.items()}
    return unique, [(s, x, t, y) for s, a in known.items() for x in a.columns for t, ys in unique.items() if t != s for y in ys if _within(a, x, known[t], y, unique[s])]


def _stem(column: str) -> str:
    return column.rpartition("_")[2].lower()


def constraints(tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    """For each table its keys and likely references as they would stand in DDL.

    Of several columns that a column lies within, only those of the same name behind the last ``_`` are likely.
    """
    unique, within = found(tables)
    out = {n: [f"UNIQUE ({c})" for c in columns] for n, columns in unique.items()}
    for s, x, t, y in within:
        if _stem(x) == _stem(y):
            out[s].append(f"FOREIGN KEY ({x}) REFERENCES {t} ({y})")
    return out
