"""A worker over all pipelines of a registry: those that are due run side by side, and one that fails holds up no other.

Jobs of pipelines that run at the same time share the session's executors; each has a scheduler pool of its own name,
so with ``spark.scheduler.mode`` FAIR none starves. The worker's rows are in the registry's table ``workers``
(started, heartbeat, stopped) and ``runs`` (a row a run). A stop marker is looked at between runs.
"""

from __future__ import annotations

import datetime
import re
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlake import config as C
from embedlake.plans.registry import Registry
from embedlake.plans.store import Table

UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
RUN = "worker string, pipeline string, began timestamp, ended timestamp, inserted long, updated long, deleted long, retried long, failed long, error string"


def interval(text: str) -> float:
    """Seconds of ``5m``, ``90 seconds``, ``1h 30m`` and the like."""
    parts = re.findall(r"(\d+(?:\.\d+)?)\s*([a-z]+)", text.lower())
    if not parts or re.sub(r"\d+(?:\.\d+)?\s*[a-z]+|\s", "", text.lower()) or any(u[0] not in UNITS for _, u in parts):
        raise ValueError(f"not an interval: {text}")
    return sum(float(n) * UNITS[u[0]] for n, u in parts)


def due(scheduling: dict, last: datetime.datetime | None, now: datetime.datetime, poll: float) -> bool:
    """Whether a pipeline runs now: periodic ones an interval after their last run began, on the grid of ``initial_start`` if the schedule is fixed; others each ``poll`` seconds."""
    if scheduling["implementation"] != "periodic":
        return last is None or (now - last).total_seconds() >= poll
    every, first = interval(scheduling.get("schedule_interval") or "5m"), scheduling.get("initial_start")
    start = datetime.datetime.fromisoformat(first) if first else None
    if start is not None and start.tzinfo is None:
        start = start.replace(tzinfo=datetime.timezone.utc)
    if start is not None and now < start:
        return False
    if last is None:
        return True
    if scheduling.get("fixed_schedule") and start is not None:
        slot = lambda t: (t - start).total_seconds() // every
        return slot(now) > slot(last)
    return (now - last).total_seconds() >= every


@dataclass
class Worker:
    """``read(source)`` gives a pipeline's source; the session's tables unless given. ``which``: numbers or names; all unless given."""

    registry: Registry
    read: Callable[[str], DataFrame] | None = None
    which: Sequence[int | str] | None = None
    poll: float = 300.0
    concurrency: int = 4
    exit_on_error: bool = False

    def __post_init__(self):
        self.spark, self.id, self.last = self.registry.spark, uuid.uuid4().hex, None

    def _table(self, name: str) -> Table:
        return Table(self.spark, f"{self.registry.path}/_{name}")

    def _say(self, event: str) -> None:
        row = self.spark.createDataFrame([(self.id, event)], "worker string, event string")
        self._table("workers").append(row.withColumn("at", F.current_timestamp()))

    def request_stop(self) -> None:
        self._table("stop").write(self.spark.range(1))

    def _stopping(self) -> bool:
        return self._table("stop").exists()

    def chosen(self) -> list[dict]:
        """Rows of the registry that this worker looks after; new and switched ones are seen at each round."""
        rows = [r.asDict() for r in self.registry.list().collect()]  # a row a pipeline
        if self.which is None:
            return [r for r in rows if not r["disabled"]]
        missing = [w for w in self.which if not any(w in (r["id"], r["name"]) for r in rows)]
        if missing:
            raise KeyError(f"no pipelines {missing}")
        return [r for r in rows if not r["disabled"] and (r["id"] in self.which or r["name"] in self.which)]

    def _before(self) -> dict[int, datetime.datetime]:
        """When periodic pipelines ran last, under any worker; others run when a worker starts."""
        if not self._table("runs").exists():
            return {}
        last = self._table("runs").read().groupBy("pipeline").agg(F.max(F.unix_millis("began")).alias("at")).collect()  # a row a pipeline
        at = {r["pipeline"]: datetime.datetime.fromtimestamp(r["at"] / 1000, datetime.timezone.utc) for r in last}
        periodic = [r for r in self.chosen() if C.from_json(r["config"])["scheduling"]["implementation"] == "periodic"]
        return {r["id"]: at[r["name"]] for r in periodic if r["name"] in at}

    def _one(self, row: dict) -> tuple:
        began, found, error = datetime.datetime.now(datetime.timezone.utc), {}, None
        if self._stopping():
            return ()
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", row["name"])
        try:
            read = self.read or self.spark.table
            found = self.registry.get(row["id"]).run(read(row["source"]))
        except Exception as e:  # it is on record, and the others go on
            error = f"{type(e).__name__}: {e}"[:2000]
        finally:
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
        ended = datetime.datetime.now(datetime.timezone.utc)
        return (self.id, row["name"], began, ended, *[found.get(k, 0) for k in ("insert", "update", "delete", "retried")], found.get("failed", 0) + found.get("not_loaded", 0), error)

    def round(self, now: datetime.datetime | None = None) -> list[tuple]:
        """Run what is due; a row a run, which are recorded in one append."""
        now = now or datetime.datetime.now(datetime.timezone.utc)
        if self.last is None:
            self.last = self._before()
        ready = [r for r in self.chosen() if due(C.from_json(r["config"])["scheduling"], self.last.get(r["id"]), now, self.poll)]
        with ThreadPoolExecutor(max(1, self.concurrency)) as pool:
            rows = [r for r in pool.map(inheritable_thread_target(self.spark)(self._one), ready) if r]
        self.last |= {r["id"]: now for r in ready}
        if rows:
            self._table("runs").append(self.spark.createDataFrame(rows, RUN))
        return rows

    def run(self, once: bool = False, look: float = 1.0, timeout: float | None = None) -> str | None:
        """Rounds until a stop marker, an error if those end it, or ``timeout`` seconds; the error or None."""
        began, beat = time.monotonic(), 0.0
        self._say("started")
        try:
            while timeout is None or time.monotonic() - began < timeout:
                if self._stopping():
                    t = self._table("stop")
                    t._fs.delete(t._path(t.path), True)
                    return None
                errors = [r[-1] for r in self.round() if r[-1]]
                if errors and self.exit_on_error:
                    return errors[0]
                if once:
                    return None
                if time.monotonic() - beat > self.poll:
                    self._say("heartbeat")
                    beat = time.monotonic()
                time.sleep(look)
            return None
        finally:
            self._say("stopped")
