"""Embedding pipelines: load, parse, chunk, format, embed and keep a store in step with its source."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedlake.config import executions, validate
from embedlake.functions.models import embed, try_embed
from embedlake.functions.template import format_column
from embedlake.operators import ann, ivf
from embedlake.operators.chunk import explode_chunks
from embedlake.plans import cdc
from embedlake.plans.store import BUCKETS, Table
from embedlake.sources.loading import payload


def chunked(loaded: DataFrame, config: dict) -> DataFrame:
    """(keys, chunk_seq, chunk, _text) of rows with ``_payload``; those whose loading failed, or without chunks, give nothing."""
    keys, formatting, chunking = config["keys"], config["formatting"], config["chunking"]
    loaded = loaded.where("_load_error is null")
    options = {k: v for k, v in chunking.items() if k not in ("implementation", "config_type")}
    if chunking["implementation"] == "none":
        cut = loaded.where("_payload <> ''").select("*", F.lit(0).alias("chunk_seq"), F.col("_payload").alias("chunk"))
    else:
        cut = explode_chunks(loaded, "_payload", chunking["implementation"], **options)
    text = F.col("chunk") if formatting["implementation"] == "chunk_value" else format_column(cut, formatting["template"])
    width = config["processing"].get("concurrency")
    ready = cut.select(*keys, "chunk_seq", "chunk", text.alias("_text"))
    return ready.repartition(width) if width else ready  # at most so many requests at a time


def plan(df: DataFrame, config: dict) -> DataFrame:
    """One lazy chain from source rows to (keys, chunk_seq, chunk, embedding).

    Rows whose loading failed, and rows without chunks, give nothing here; a request that fails fails it all.
    """
    ready = chunked(payload(df, config["loading"], config["parsing"]), config)
    return ready.select(*config["keys"], "chunk_seq", "chunk", embed("_text", config["embedding"], config["processing"].get("batch_size")).alias("embedding"))


def attempts(loaded: DataFrame, config: dict) -> DataFrame:
    """(keys, chunk_seq, chunk, embedding, error): as ``plan``, with the error of each request that failed in place of its vectors."""
    tried = chunked(loaded, config).withColumn("_got", try_embed("_text", config["embedding"], config["processing"].get("batch_size")))
    return tried.select(*config["keys"], "chunk_seq", "chunk", F.col("_got.value").alias("embedding"), F.col("_got.error").alias("error"))


def embedding_view(store: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks with the columns of their source rows; keys from the store's side. One key row can stay unjoined."""
    rest = [c for c in source.columns if c not in keys]
    return store.join(source.select(*keys, *rest), keys, "left")


def with_column(source: DataFrame, vectors: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``source`` with an embedding column, from vectors of single chunks where there are any."""
    new = vectors.select(*keys, F.col("embedding").alias("_new"))
    old = F.col(column) if column in source.columns else F.lit(None).cast("array<float>")
    return source.join(new, keys, "left").withColumn(column, F.coalesce("_new", old)).drop("_new")


@dataclass
class Pipeline:
    """A configuration with its tables below ``path``: store, queue, dead, errors, progress, source state.

    The state holds keys and hashes of rows. With a column for destination, ``target`` holds the source's rows
    with that column. Store, state and target lie in ``buckets``; a run rewrites those that it touches.
    """

    spark: SparkSession
    config: dict
    path: str
    disabled: bool = False
    buckets: int = BUCKETS

    def table(self, name: str) -> Table:
        return Table(self.spark, f"{self.path}/{name}", self.buckets)

    def validate(self, source: DataFrame) -> None:
        for kind in ("loading", "parsing", "chunking", "formatting", "embedding", "indexing", "scheduling", "processing", "destination"):
            validate(kind, self.config[kind], source.schema, self.config["loading"], self.config["chunking"])

    def _queue(self) -> DataFrame | None:
        t = self.table("queue")
        return t.read() if t.exists() else None

    def _keys(self, df: DataFrame) -> DataFrame:
        return df.select(*self.config["keys"]).distinct()

    def run_full(self, source: DataFrame) -> None:
        """Compute the whole store anew."""
        self.validate(source)
        self._write(source, self._keys(source), None, first=True)
        self.table("state").write(cdc.state_of(source, self.config["keys"], self._ignored()), keys=self.config["keys"])

    def _ignored(self) -> list[str]:
        own = self.config["destination"].get("embedding_column")
        return [own] if own else []

    def run(self, source: DataFrame, now=None, batch: int | None = None) -> dict:
        """Bring the store in step with ``source``: new and changed rows are embedded, deleted ones go, due ones are tried again."""
        if self.disabled:
            return {"insert": 0, "update": 0, "delete": 0, "retried": 0}
        self.validate(source)
        keys, state = self.config["keys"], self.table("state")
        if state.exists():
            ops = cdc.diff_state(state.read(), source, keys, self._ignored()).where("op <> 'same'").persist()
        else:
            ops = cdc.state_of(source, keys, self._ignored()).withColumn("op", F.lit("insert")).persist()
        counts = {r["op"]: r["count"] for r in ops.groupBy("op").count().collect()}
        queue = self._queue()
        due = cdc.claim(queue, keys, now) if queue is not None else None
        work = self._keys(ops.where("op <> 'delete'"))
        retries = work.withColumn("loading_retries", F.lit(0))
        retried, done = 0, {"failed": 0, "not_loaded": 0}
        if due is not None:
            again = due.join(work, keys, "left_anti")
            retried = again.count()
            retries = retries.unionByName(again.select(*keys, F.col("loading_retries").cast("int")))
        if counts or retried:
            done = self._write(source, retries, self._keys(ops.where("op = 'delete'")), now, batch)
            state.upsert(ops.where("op <> 'delete'").select(*keys, "_h1", "_h2"), keys, ops.select(*keys), batch)
        ops.unpersist()
        return {"insert": 0, "update": 0, "delete": 0} | counts | {"retried": retried} | done

    def _write(self, source: DataFrame, work: DataFrame, gone: DataFrame | None, now=None, batch: int | None = None, first: bool = False) -> dict:
        keys = self.config["keys"]
        rows = source.join(work.select(*keys).distinct(), keys, "left_semi")
        loaded = payload(rows, self.config["loading"], self.config["parsing"])
        if self.config["loading"]["implementation"] == "uri":  # what is opened is opened once
            table = self.table("loaded")
            table.write(loaded, batch)
            loaded = table.read()
        tries = work if "loading_retries" in work.columns else work.withColumn("loading_retries", F.lit(0))
        return self.commit(loaded, tries, gone, now, batch, first)

    def commit(self, loaded: DataFrame, work: DataFrame, gone: DataFrame | None = None, now=None, batch: int | None = None, first: bool = False, unloaded: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> dict:
        """Embed ``loaded`` (source rows, _payload, _load_error), keep what went well, and queue and record the rest.

        ``work``: (keys, loading_retries) of all rows tried. Requests are made once: their vectors and errors lie in
        a table before anything else changes. Keys with a failed request keep the chunks that they had, and are due
        again at once. With ``batch`` each table takes a batch's rows once, so a batch may run again. ``unloaded``:
        what failed to load and was settled elsewhere, as rows for the queue, dead letters, and (keys, error, loading_retries).
        """
        keys, tried = self.config["keys"], self.table("attempts")
        try:
            if batch is None or not tried.exists() or tried.batch() != batch:
                tried.write(attempts(loaded, self.config), batch)
        except Exception as e:
            self._error("vectorizer failed with unexpected error", {"error_reason": str(e)[:2000]})
            self._progress(0, work.count(), type(e).__name__)
            raise
        made = tried.read()
        failed = self._keys(made.where("error is not null"))
        new, settled = made.where("error is null").drop("error"), work.select(*keys)
        if not made.where("error is not null").isEmpty():  # else texts would be shuffled for nothing
            new, settled = new.join(failed, keys, "left_anti"), settled.join(failed, keys, "left_anti")
        # rows without chunks lose their old ones too
        drop = settled if gone is None else settled.unionByName(gone.select(*keys))
        store = self.table("store")
        if first:
            store.write(new, batch, keys)
        else:
            store.upsert(new, keys, drop, batch)
        column = self.config["destination"].get("embedding_column")
        if column:
            source = loaded.drop("_payload", "_load_error").join(failed, keys, "left_anti")
            own = with_column(source, store.read().where("chunk_seq = 0"), keys, column)
            target = self.table("target")
            if first:
                target.write(own, batch, keys)
            else:
                target.upsert(own, keys, drop, batch)
        limit = self.config["loading"].get("retries", 0)
        if unloaded is None:
            bad = work.join(loaded.where("_load_error is not null").select(*keys, F.col("_load_error").alias("error")), keys)
            later, dead = cdc.settle(bad, keys, limit, now)
        else:
            later, dead, bad = unloaded
        later = later.select(*keys, F.col("loading_retries").cast("int").alias("loading_retries"), "loading_retry_after")
        again = failed.join(work, keys).select(*keys, F.col("loading_retries").cast("int").alias("loading_retries"), F.lit(None).cast("timestamp").alias("loading_retry_after"))
        later, queue = later.unionByName(again), self.table("queue")
        if queue.exists() or not later.isEmpty():
            done = work.select(*keys)
            queue.upsert(later, keys, done if gone is None else done.unionByName(gone.select(*keys)), batch)
        if not dead.isEmpty():
            self.table("dead").append(dead, batch)
        total, n_bad, n_failed = work.count(), bad.count(), failed.count()
        if n_bad or n_failed:
            loading = F.to_json(F.struct(F.lit("loading").alias("step"), F.col("error").alias("error_reason"), (F.col("loading_retries") < limit).alias("is_retryable"), *[F.col(k) for k in keys]))
            asked = F.to_json(F.struct(F.lit(self.config["embedding"]["implementation"]).alias("provider"), F.col("error").alias("error_reason"), F.col("n").alias("chunks")))
            reasons = made.where("error is not null").groupBy("error").agg(F.count("*").alias("n"))
            self._record(bad.select(F.lit("loading failed").alias("message"), loading.alias("details")).unionByName(reasons.select(F.lit("embedding provider failed").alias("message"), asked.alias("details"))), batch)
        last = "embedding provider failed" if n_failed else "loading failed" if n_bad else None
        self._progress(total - n_bad - n_failed, n_bad + n_failed, last, batch)
        return {"failed": n_failed, "not_loaded": n_bad}

    def _record(self, rows: DataFrame, batch: int | None = None) -> None:
        """Add ``rows`` (message, details) to the errors."""
        self.table("errors").append(rows.select(F.lit(self.config["name"]).alias("name"), "message", "details", F.current_timestamp().alias("recorded")), batch)

    def _error(self, message: str, details: dict) -> None:
        self._record(self.spark.createDataFrame([(message, json.dumps(details))], "message string, details string"))

    def _progress(self, ok: int, bad: int, error: str | None, batch: int | None = None) -> None:
        row = self.spark.createDataFrame([(self.config["name"], ok, bad, error)], "name string, success_count long, error_count long, last_error string")
        self.table("progress").append(row.select("name", F.current_timestamp().alias("at"), "success_count", "error_count", "last_error"), batch)

    def status(self) -> DataFrame:
        """name, source, target, view, embedding column, pending, disabled."""
        d, q = self.config["destination"], self._queue()
        row = (self.config["name"], self.config["source"], d.get("target_table"), d.get("view_name"), d.get("embedding_column", "embedding"), 0 if q is None else cdc.pending(q), self.disabled)
        return self.spark.createDataFrame([row], "name string, source_table string, target_table string, view string, embedding_column string, pending_items long, disabled boolean")

    def maybe_index(self, path: str) -> bool:
        """Build the index, with the configuration's parameters, if its policy allows; True if it was built.

        Readers see an index when it is whole. An index that is there is left as it is.
        """
        i = self.config["indexing"]
        if i["implementation"] == "none" or not self.table("store").exists():
            return False
        store, q = self.table("store").read(), self._queue()
        least = i.get("min_rows", 100_000)
        index = ann.Index(self.spark, path, [*self.config["keys"], "chunk_seq"])
        if not ivf.may_build(store.limit(least).count(), 0 if q is None else cdc.pending(q), index.exists(), least, i.get("create_when_queue_empty", True)):
            return False
        index.build(store, i.get("opclass", "vector_cosine_ops"), ann.Options.of(i))
        return True

    def executions(self) -> int:
        q = self._queue()
        return executions(0 if q is None else cdc.pending(q))
