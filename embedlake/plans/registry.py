"""A lasting registry of pipelines: created, listed, switched off and on, and dropped, by number or name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from embedlake import config as C
from embedlake.plans.pipeline import Pipeline
from embedlake.plans.store import Table

ROWS = "id long, name string, source string, config string, path string, disabled boolean"


class Registry:
    """Pipelines below one folder; a few rows, so a change rewrites the table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._table = Table(spark, f"{self.path}/_registry")

    def list(self) -> DataFrame:
        return self._table.read() if self._table.exists() else self.spark.createDataFrame([], ROWS)

    def _rows(self) -> list[dict]:
        return [r.asDict() for r in self.list().collect()]

    def _keep(self, rows: list[dict]) -> None:
        names = [x.split()[0] for x in ROWS.split(", ")]
        self._table.write(self.spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ROWS).coalesce(1))

    def _find(self, which: int | str) -> dict:
        for r in self._rows():
            if which in (r["id"], r["name"]):
                return r
        raise KeyError(f"no pipeline {which}")

    def create(self, config: dict, if_not_exists: bool = False) -> int:
        """A number for a new pipeline; a name is taken once."""
        rows = self._rows()
        for r in rows:
            if r["name"] == config["name"]:
                if if_not_exists:
                    return r["id"]
                raise ValueError(f"a pipeline named {config['name']} exists")
        number = max((r["id"] for r in rows), default=0) + 1
        self._keep([*rows, {"id": number, "name": config["name"], "source": config["source"], "config": C.to_json(config), "path": f"{self.path}/{number}", "disabled": False}])
        return number

    def get(self, which: int | str) -> Pipeline:
        r = self._find(which)
        return Pipeline(self.spark, C.from_json(r["config"]), r["path"], r["disabled"])

    def _switch(self, which: int | str, disabled: bool) -> None:
        number = self._find(which)["id"]
        self._keep([r | {"disabled": disabled} if r["id"] == number else r for r in self._rows()])

    def disable(self, which: int | str) -> None:
        self._switch(which, True)

    def enable(self, which: int | str) -> None:
        self._switch(which, False)

    def drop(self, which: int | str, drop_all: bool = False) -> None:
        """Forget a pipeline; its tables too if ``drop_all``."""
        found = self._find(which)
        self._keep([r for r in self._rows() if r["id"] != found["id"]])
        if drop_all:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(found["path"])
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
