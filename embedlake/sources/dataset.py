"""Dataset loading: files or a generator into a table, with derived names, flattened structs and type overrides."""

from __future__ import annotations

import inspect
import itertools
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from embedlake.sources import commits

NAME_BYTES = 63
MODES = {"error": "errorifexists", "append": "append", "drop": "overwrite"}


def table_name(dataset: str, config: str | None = None) -> str:
    """The last part of a dataset's name, with its configuration, as an identifier of at most 63 bytes."""
    base = dataset.rstrip("/").rsplit("/", 1)[-1] + (f"_{config}" if config else "")
    name = "".join(c if c.isalnum() else "_" for c in base.lower())
    if len(name.encode()) <= NAME_BYTES:
        return name
    head = name[:NAME_BYTES]
    cut = head.rstrip("_").rfind("_")
    return head[:cut] if cut > 0 else head


def flatten(df: DataFrame) -> DataFrame:
    """Struct columns as ``a_b`` columns, at every depth."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema):
        cols = []
        for f in df.schema:
            if isinstance(f.dataType, T.StructType):
                cols += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}_{g.name}") for g in f.dataType]
            else:
                cols.append(F.col(f"`{f.name}`"))
        df = df.select(*cols)
    return df


class _Rows(DataSourceReader):
    """Splits of a generator: all of each, the first rows, or a slice of each with the split's name."""

    def __init__(self, make: Callable, splits: list[str], limit: int | None, starts: dict[str, int] | None):
        self.make, self.splits, self.limit, self.starts = make, splits, limit, starts

    def partitions(self):
        return [InputPartition(s) for s in (self.splits if self.starts is None else self.starts)]

    def read(self, partition) -> Iterator[tuple]:
        split = partition.value
        if self.starts is None:
            yield from itertools.islice(self.make(split), self.limit)
            return
        start = self.starts[split]
        if len(inspect.signature(self.make).parameters) > 1:
            rows = self.make(split, start)
        else:
            rows = itertools.islice(self.make(split), start, None)
        for row in itertools.islice(rows, self.limit):
            yield (*row, split)


class _Names(DataSourceReader):
    def __init__(self, splits: list[str]):
        self.splits = splits

    def read(self, partition) -> Iterator[tuple]:
        yield from ((s,) for s in self.splits)


def generator_source(name: str, schema: str, make: Callable[..., Iterator[tuple]], splits: list[str]) -> type[DataSource]:
    """A data source over ``make(split)``; register it with ``spark.dataSource.register``.

    Options: ``split`` reads one split, ``rows`` the first rows of each, ``names`` gives the splits' names in place of rows, and
    ``starts`` (JSON, a number of rows for each split) reads on from there, with the column ``_split``. If ``make`` takes a
    second argument it gets the start; otherwise the rows before it are passed over.
    """

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            if self.options.get("names"):
                return "name string"
            return f"{schema}, _split string" if self.options.get("starts") else schema

        def reader(self, schema):
            wanted, limit, starts = self.options.get("split"), self.options.get("rows"), self.options.get("starts")
            own = [wanted] if wanted else splits
            if self.options.get("names"):
                return _Names(own)
            return _Rows(make, own, int(limit) if limit else None, json.loads(starts) if starts else None)

    return Source


FILES = ("parquet", "json", "csv", "orc")


def _adapted(df: DataFrame, field_types: dict[str, str] | None) -> DataFrame:
    df = flatten(df)
    for c, kind in (field_types or {}).items():
        df = df.withColumn(c, F.col(c).cast(kind))
    return df


def load_dataset(
    spark: SparkSession, name: str, config: str | None = None, split: str | None = None, table: str | None = None, if_table_exists: str = "error",
    field_types: dict[str, str] | None = None, batch_size: int = 5000, max_batches: int | None = None, format: str = "parquet", schema: str = "default",
    commit_every_n_batches: int | None = None,
) -> int:
    """Load a dataset (a path, or the name of a registered source) into a table; returns the rows loaded.

    With ``commit_every_n_batches`` rows are committed piece by piece: of a registered source ``batch_size`` rows of each
    split times that number, of a path so many files. A load that was stopped and is asked for again goes on behind its
    last commit, whatever ``if_table_exists`` says but ``drop``, which begins anew; it returns the rows of all its commits.
    """
    if if_table_exists not in MODES:
        raise ValueError(f"if_table_exists must be one of {', '.join(MODES)}")
    if table is not None and len(table.encode()) > NAME_BYTES:
        raise ValueError(f"Table name '{table}' exceeds the {NAME_BYTES} character limit")
    if commit_every_n_batches is not None and commit_every_n_batches < 1:
        raise ValueError("commit_every_n_batches must be at least 1")
    path, reader = f"{name}/{split}" if split else name, spark.read.format(format)
    if format in FILES:
        raw = reader.options(**({"header": "true"} if format == "csv" else {})).load(path)
    else:
        raw = (reader.option("split", split) if split else reader).load()
    df = _adapted(raw, field_types)
    rows = None if max_batches is None else batch_size * max_batches
    target = f"{schema}.{table or table_name(name, config)}"
    if commit_every_n_batches is None:
        df = df if rows is None else df.limit(rows)
        before = spark.table(target).count() if if_table_exists == "append" and spark.catalog.tableExists(target) else 0
        df.write.mode(MODES[if_table_exists]).saveAsTable(target)
        return spark.table(target).count() - before

    if if_table_exists == "drop":
        spark.sql(f"DROP TABLE IF EXISTS {target}")
    there = spark.catalog.tableExists(target)
    if not there:
        spark.createDataFrame([], df.schema).write.saveAsTable(target)
    load = commits.Load(spark, target, json.dumps([name, config, split, format]))
    if there and if_table_exists == "error" and not load.begun():
        raise ValueError(f"table {target} exists")
    load.begin()
    columns = [F.col(f"`{f.name}`").cast(f.dataType) for f in spark.table(target).schema]
    if format in FILES:
        stream = spark.readStream.format(format).schema(raw.schema).option("maxFilesPerTrigger", commit_every_n_batches)
        if format == "csv":
            stream = stream.option("header", "true")
        if load.is_file(path):
            parent, _, own = path.rpartition("/")
            stream, path = stream.option("pathGlobFilter", own), parent
        commits.stream_files(load, stream.load(path), lambda batch: _adapted(batch, field_types).select(*columns), rows)
    else:
        names = spark.read.format(format).option("names", "true")
        splits = [r["name"] for r in (names.option("split", split) if split else names).load().collect()]

        def read(starts: dict[str, int], width: int) -> DataFrame:
            part = spark.read.format(format).option("starts", json.dumps(starts)).option("rows", width).load()
            return _adapted(part, field_types).select(*columns, "_split")

        commits.slices(load, read, splits, batch_size * commit_every_n_batches, rows)
    load.finish()
    return load.rows()


def dechunk(df: DataFrame, keys: list[str], text_col: str, order_col: str, separator: str = "\n\n") -> DataFrame:
    """Paragraphs joined again in order, a row per key."""
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order_col, text_col))), lambda x: x[text_col]), separator).alias(text_col))
