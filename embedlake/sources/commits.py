"""Loads that are committed piece by piece: a load that was killed goes on behind its last commit, without repeats.

A commit has four steps: the rows are written to a hidden folder below the table's; a plan names the files; they are
moved to the table; a mark is left. What was killed before its plan is written anew, what was killed later has its
moves finished, and what has a mark is not done again. Readers see files as they are moved, as in any job's commit.
One writer a table. Files that are gone from the hidden folder have been moved.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Load:
    """The commits of one load into a table of the session's catalogue."""

    def __init__(self, spark: SparkSession, table: str, name: str):
        self.spark, self.table, self.name = spark, table, hashlib.sha256(name.encode()).hexdigest()[:16]
        about = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
        self.provider, self.location = about["Provider"], about["Location"]
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.location).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        top = f"{self.location}/_loads/{self.name}"
        n = 0
        while self._there(f"{top}-{n}/_done"):
            n += 1
        self.load, self.folder = f"{self.name}-{n}", f"{top}-{n}"

    def _there(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def _get(self, name: str) -> dict | None:
        if not self._there(name):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, value: dict) -> None:
        """Whole or not at all."""
        work = self._path(f"{name}.tmp")
        out = self._fs.create(work, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if not self._fs.rename(work, self._path(name)):
            raise OSError(f"cannot write {name}")

    def is_file(self, name: str) -> bool:
        p = self._path(name)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.exists(p) and fs.getFileStatus(p).isFile()

    def begun(self) -> bool:
        return self._there(self.folder)

    def begin(self) -> None:
        self._fs.mkdirs(self._path(self.folder))

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))] if self._there(folder) else []

    def marks(self) -> list[dict]:
        """What has been committed, in order."""
        numbers = sorted(int(n[:-5]) for n in self._names(self.folder) if n.endswith(".json"))
        return [self._get(f"{self.folder}/{k}.json") for k in numbers]

    def commit(self, batch: int, df: DataFrame, by: str | None = None, **more) -> dict:
        """Add ``df`` as the commit ``batch`` unless it was added before; its mark has ``rows``, and ``counts`` for each value of a column ``by``, which is not kept."""
        mark, stage = f"{self.folder}/{batch}.json", f"{self.folder}/stage-{batch}"
        found = self._get(mark)
        if found is not None:
            return found
        plan = self._get(f"{stage}/_plan")
        if plan is None:
            self._fs.delete(self._path(stage), True)
            df.write.format(self.provider).partitionBy(*([by] if by else [])).save(f"{stage}/rows")
            folders = [f"{stage}/rows/{n}" for n in self._names(f"{stage}/rows") if "=" in n] if by else [f"{stage}/rows"]
            files = [f"{f}/{n}" for f in folders for n in self._names(f) if n[0] not in "_."]
            staged = self.spark.read.format(self.provider).schema(df.schema).load(f"{stage}/rows")
            counts = {r[by]: r["count"] for r in staged.groupBy(by).count().collect()} if by else {}  # a row a split
            rows = sum(counts.values()) if by else staged.count()
            plan = more | {"batch": batch, "rows": rows, "counts": counts, "files": files if rows else []}
            self._put(f"{stage}/_plan", plan)
        for k, name in enumerate(plan["files"]):
            here = self._path(name)
            if self._fs.exists(here) and not self._fs.rename(here, self._path(f"{self.location}/{self.load}-{batch}-{k}-{here.getName()}")):
                raise OSError(f"cannot move {name}")
        plan = {k: v for k, v in plan.items() if k != "files"}
        self._put(mark, plan)
        self._fs.delete(self._path(stage), True)
        self.spark.catalog.refreshTable(self.table)
        return plan

    def finish(self) -> None:
        """The load is whole; the next one of the same name is another."""
        self._put(f"{self.folder}/_done", {})

    def rows(self) -> int:
        return sum(m["rows"] for m in self.marks())


def stream_files(load: Load, files: DataFrame, change: Callable[[DataFrame], DataFrame], rows: int | None = None) -> None:
    """Commit a stream of files, a micro-batch a commit; at most ``rows`` rows of them all."""

    def each(df: DataFrame, batch: int) -> None:
        df = change(df)
        if rows is not None:
            left = rows - sum(m["rows"] for m in load.marks() if m["batch"] < batch)
            df = df.limit(left)
        load.commit(batch, df)

    files.writeStream.foreachBatch(each).option("checkpointLocation", f"{load.folder}/stream").trigger(availableNow=True).start().awaitTermination()


def slices(load: Load, read: Callable[[dict[str, int], int], DataFrame], splits: list[str], step: int, rows: int | None = None) -> None:
    """Commit slices of splits, each at most ``step`` rows a commit, until all have ended.

    ``read(starts, step)``: rows with their split in the column ``_split``. A split whose slice is short has ended.
    """
    at, ended, taken, batch = dict.fromkeys(splits, 0), set(), 0, 0

    def count(mark: dict) -> None:
        nonlocal taken, batch
        for split in mark["asked"]:
            got = mark["counts"].get(split, 0)
            at[split] += got
            if got < mark["width"]:
                ended.add(split)
        taken, batch = taken + mark["rows"], mark["batch"] + 1

    for mark in load.marks():
        count(mark)
    while True:
        going = [s for s in splits if s not in ended]
        if rows is not None:
            going = going[: max(0, rows - taken)]
        if not going:
            return
        width = step if rows is None else min(step, (rows - taken) // len(going))
        count(load.commit(batch, read({s: at[s] for s in going}, width), "_split", width=width, asked=going))
