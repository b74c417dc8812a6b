"""Pipelines as streaming queries: a micro-batch of changes is a batch of work, and failed loads wait in the query's state.

A pipeline that loads from URIs opens them within a stateful operator keyed by row: what fails stays there, with its
row and the number of tries, and a timer opens it again after 3, 6, 9, ... minutes; the last failure is a dead letter. A
newer change of the row takes the place of the one that waits. The operator's rows are written once a micro-batch
before anything is done with them, and each table of the pipeline takes a batch once, so a batch may run again.
Rows whose embedding failed wait in the table ``waiting`` and go along with the next micro-batch.
"""

from __future__ import annotations

import datetime
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from embedlake.plans import cdc
from embedlake.plans.pipeline import Pipeline
from embedlake.sources.loading import open_uri, parse_value, payload

#: What the operator says of a row: loaded, deleted, waiting for its timer, or given up.
LOADED, GONE, LATER, DEAD = "load", "delete", "later", "dead"


def opened(uri: str | None, loading: dict, parsing: dict) -> tuple[str | None, str | None]:
    """(text, error) of what is behind a URI."""
    try:
        return parse_value(open_uri(uri, loading.get("aws_role_arn")), uri, parsing["implementation"]), None
    except Exception as e:  # the row is tried again later
        return None, f"{type(e).__name__}: {e}"


class Loader(StatefulProcessor):
    """Opens the URI of each row's last change; state holds rows that wait, and nothing else."""

    def __init__(self, keys: list[str], kinds: dict[str, T.DataType], order: T.DataType, loading: dict, parsing: dict, minutes: float):
        self.keys, self.kinds, self.order, self.loading, self.parsing, self.minutes = keys, kinds, order, loading, parsing, minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [T.StructField("row", T.StringType()), T.StructField("uri", T.StringType()), T.StructField("place", self.order), T.StructField("tries", T.IntegerType())]
        self.held = handle.getValueState("held", T.StructType(fields))

    def _forget(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.held.clear()

    def _try(self, key: tuple, row: str, uri: str | None, place, tries: int, now: int):
        import pandas as pd

        text, error = opened(uri, self.loading, self.parsing)
        kind, after = LOADED, None
        if error is not None:
            kind = LATER if tries < self.loading.get("retries", cdc.MAX_RETRIES) else DEAD
        if kind == LATER:
            at = now + int(self.minutes * 60_000 * (tries + 1))
            self.held.update((row, uri, place, tries + 1))
            self.handle.registerTimer(at)
            after = datetime.datetime.fromtimestamp(at / 1000, datetime.UTC).replace(tzinfo=None)
        return pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key, strict=True)}, "_row": [row], "_kind": [kind], "_payload": [text], "_load_error": [error], "_tries": [tries], "_after": [pd.Timestamp(after) if after else pd.NaT]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        last = None
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if last is None or r[-1] > last[-1]:
                    last = (r[-4], r[-3], r[-2], r[-1])  # row, uri, op, place
        row, uri, op, place = last
        if self.held.exists():
            if self.held.get()[2] > place:
                return
            self._forget()
        if op == "delete":
            yield pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key, strict=True)}, "_row": [row], "_kind": [GONE], "_payload": [None], "_load_error": [None], "_tries": [0], "_after": [pd.NaT]})
            return
        yield self._try(key, row, uri, place, 0, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        if not self.held.exists():
            return
        row, uri, place, tries = self.held.get()
        self._forget()
        yield self._try(key, row, uri, place, tries, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def loaded_stream(pipeline: Pipeline, changes: DataFrame, op: str, order: str, minutes: float = cdc.RETRY_MINUTES) -> DataFrame:
    """The keys with _row (JSON of the source row), _kind, _payload, _load_error, _tries and _after, as loads succeed or fail."""
    keys, loading = pipeline.config["keys"], pipeline.config["loading"]
    kinds = {k: changes.schema[k].dataType for k in keys}
    rest = [c for c in changes.columns if c not in (op, order)]
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest]))
    rows = changes.select(*keys, row.alias("_row"), F.col(f"`{loading['column_name']}`").alias("_uri"), F.col(op).alias("_op"), F.col(order).alias("_place"))
    out = T.StructType([
        *[T.StructField(k, t) for k, t in kinds.items()], T.StructField("_row", T.StringType()), T.StructField("_kind", T.StringType()), T.StructField("_payload", T.StringType()),
        T.StructField("_load_error", T.StringType()), T.StructField("_tries", T.IntegerType()), T.StructField("_after", T.TimestampType()),
    ])
    loader = Loader(list(keys), kinds, changes.schema[order].dataType, loading, pipeline.config["parsing"], minutes)
    return rows.groupBy(*keys).transformWithStateInPandas(loader, out, "append", "ProcessingTime")


def apply_loaded(pipeline: Pipeline, batch_rows: DataFrame, batch: int, source: T.StructType) -> None:
    """One micro-batch of ``loaded_stream``: rows of the store, the queue, dead letters, errors and progress."""
    keys, staged = pipeline.config["keys"], pipeline.table("incoming")
    if not staged.exists() or staged.batch() != batch:
        staged.write(batch_rows, batch)
    rows = staged.read()
    gone = rows.where(F.col("_kind") == GONE)
    good = rows.where(F.col("_kind") == LOADED)
    bad = rows.where(F.col("_kind").isin(LATER, DEAD)).select(*keys, F.col("_load_error").alias("error"), F.col("_tries").alias("loading_retries"), "_kind", "_after")
    later = bad.where(F.col("_kind") == LATER).select(*keys, (F.col("loading_retries") + 1).alias("loading_retries"), F.col("_after").alias("loading_retry_after"))
    dead = bad.where(F.col("_kind") == DEAD).select(*keys, F.lit("loading").alias("failure_step"))
    back = F.from_json("_row", source)
    loaded = good.select(back.alias("_s"), "_payload", "_load_error").select("_s.*", "_payload", "_load_error")
    work = rows.where(F.col("_kind") != GONE).select(*keys, F.col("_tries").alias("loading_retries"))
    _commit(pipeline, loaded, work, gone.select(*keys), batch, (later, dead, bad.drop("_kind", "_after")))


def apply_changes(pipeline: Pipeline, changes: DataFrame, batch: int, op: str = "op", order: str = "version") -> None:
    """One micro-batch without state: the last change of each key; deletes drop chunks, the rest are embedded and replaced.

    A batch that runs again after a failure does again what is left to do.
    """
    keys = pipeline.config["keys"]
    last = cdc.latest(changes, keys, [order]).persist()
    rows = last.where(F.col(op) != "delete").drop(op, order)
    loaded = payload(rows, pipeline.config["loading"], pipeline.config["parsing"])
    _commit(pipeline, loaded, rows.select(*keys, F.lit(0).alias("loading_retries")), last.where(F.col(op) == "delete").select(*keys), batch, None)
    last.unpersist()


def _commit(pipeline: Pipeline, loaded: DataFrame, work: DataFrame, gone: DataFrame, batch: int, unloaded) -> None:
    """Commit a micro-batch with the rows that wait because their embedding failed, unless it has newer ones."""
    keys, waiting = pipeline.config["keys"], pipeline.table("waiting")
    if waiting.exists() and waiting.batch() != batch:
        new = work.select(*keys).unionByName(gone.select(*keys))
        pipeline.table("rejoined").write(waiting.read().join(new, keys, "left_anti"), batch, keys)
    rejoined = pipeline.table("rejoined")
    if rejoined.exists() and rejoined.batch() == batch:
        loaded = loaded.unionByName(rejoined.read())
        work = work.unionByName(rejoined.read().select(*keys, F.lit(0).alias("loading_retries")))
    pipeline.commit(loaded, work, gone, batch=batch, unloaded=unloaded)
    failed = pipeline.table("attempts").read().where("error is not null").select(*keys).distinct()
    some = not failed.isEmpty()
    kept = loaded.join(failed, keys, "left_semi") if some else loaded.limit(0)
    if waiting.exists() or some and not kept.isEmpty():
        waiting.write(kept, batch, keys) if waiting.batch() != batch else None


class Heartbeat(StreamingQueryListener):
    """Records a query's start, progress, idle times and end in a pipeline's table ``workers``."""

    def __init__(self, pipeline: Pipeline):
        self.pipeline, self.query = pipeline, None

    def _say(self, event: str, batch: int | None = None, rows: int | None = None, error: str | None = None) -> None:
        row = (self.pipeline.config["name"], str(self.query), event, batch, rows, error)
        df = self.pipeline.spark.createDataFrame([row], "name string, query string, event string, batch long, rows long, error string")
        self.pipeline.table("workers").append(df.withColumn("at", F.current_timestamp()))

    def _own(self, event) -> bool:
        return self.query is not None and str(event.id) == str(self.query)

    def onQueryStarted(self, event) -> None:
        pass  # the query's id isn't known to the listener yet; ``start`` records it

    def onQueryProgress(self, event) -> None:
        if str(event.progress.id) == str(self.query):
            self._say("progress", event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        if self._own(event):
            self._say("heartbeat")

    def onQueryTerminated(self, event) -> None:
        if self._own(event):
            self._say("failed" if event.exception else "stopped", error=event.exception and event.exception[:2000])


def request_stop(pipeline: Pipeline) -> None:
    """Ask the pipeline's worker to stop behind the micro-batch that it is at."""
    pipeline.table("stop").write(pipeline.spark.range(1))


def stop_requested(pipeline: Pipeline) -> bool:
    return pipeline.table("stop").exists()


def clear_stop(pipeline: Pipeline) -> None:
    t = pipeline.table("stop")
    t._fs.delete(t._path(t.path), True)


def start(pipeline: Pipeline, changes: DataFrame, checkpoint: str, once: bool = False, poll: str = "5 minutes", op: str = "op", order: str = "version", retry_minutes: float = cdc.RETRY_MINUTES) -> StreamingQuery:
    """Keep the store in step with a stream of changes (key columns, row columns, ``op``, ``order``).

    Retries of URIs need a trigger that goes on (not ``once``) and RocksDB for a state store, which is set here.
    """
    spark = pipeline.spark
    uri = pipeline.config["loading"]["implementation"] == "uri"
    source = T.StructType([f for f in changes.schema.fields if f.name not in (op, order)])
    if uri:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        changes = loaded_stream(pipeline, changes, op, order, retry_minutes)

    def each(df: DataFrame, batch: int) -> None:
        if pipeline.disabled:
            return
        if uri:
            apply_loaded(pipeline, df, batch, source)
        else:
            apply_changes(pipeline, df, batch, op, order)

    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=poll)).start()


def watch(pipeline: Pipeline, query: StreamingQuery, every: float = 1.0, timeout: float | None = None) -> bool:
    """Wait for the end of a query, with heartbeats; a stop marker ends it between two micro-batches. True if the marker did.

    A micro-batch that has begun when the marker is seen is finished first; were it cut off nevertheless, it would run
    again, as each table takes a batch once.
    """
    spark, beat, began = pipeline.spark, Heartbeat(pipeline), time.monotonic()
    beat.query = query.id
    beat._say("started")
    spark.streams.addListener(beat)
    try:
        while query.isActive and (timeout is None or time.monotonic() - began < timeout):
            if stop_requested(pipeline):
                done = lambda: (query.lastProgress or {}).get("batchId", -1)
                seen = done()
                while query.isActive and query.status["isTriggerActive"] and done() == seen:
                    time.sleep(0.05)
                query.stop()
                clear_stop(pipeline)
                beat._say("stopped")
                return True
            query.awaitTermination(every)
        return False
    finally:
        spark.streams.removeListener(beat)


def windowed_counts(events: DataFrame, time_col: str, by: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums in tumbling windows; as a stream, windows close ``late`` after their end."""
    timed = events.withColumn("_t", F.col(time_col).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("bucket"), by, "n", "total")
