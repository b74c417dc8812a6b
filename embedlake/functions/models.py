"""Model-calling functions: columns, and SQL functions under the prefix ``ai_``.

Requests leave from Arrow batches; the provider is made once a task. Results of structured calls are JSON.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embedlake.functions import providers as P

#: Provider configurations that the SQL functions use, by the first part of their names.
SQL_PROVIDERS = {k: {"implementation": k} for k in ("hash", "openai", "ollama", "anthropic", "cohere", "voyageai", "litellm")}
#: Tasks by provider, as SQL functions ``ai_<provider>_<task>(request JSON)``; fixed values.
TASKS = {
    "openai": ("chat_complete", "moderate", "tokenize", "detokenize", "list_models"), "ollama": ("generate", "chat_complete", "list_models", "ps"), "anthropic": ("generate", "list_models"),
    "cohere": ("chat_complete", "classify", "rerank", "tokenize", "detokenize", "list_models"), "voyageai": ("rerank",), "hash": ("chat_complete", "moderate", "tokenize", "detokenize", "classify", "rerank", "list_models"),
}


#: Bytes of texts that a task holds as Python's strings at once, about; a request is never larger than what it holds.
HELD = 4 << 20


def _pieces(batch: pa.Array, most: int) -> Iterator[list[str | None]]:
    """The texts of a batch in runs of at most ``most`` texts and ``HELD`` bytes, or of one text."""
    so_far = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(batch):
        last = int(np.searchsorted(so_far, (so_far[first - 1] if first else 0) + HELD, side="right"))
        last = min(max(first + 1, last), first + most)
        yield batch.slice(first, last - first).to_pylist()
        first = last


def embed(text: Column | str, config: dict, most: int | None = None) -> Column:
    """Vectors of a text column; null for null text. ``most``: texts of a request at most, if its provider takes as many."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        source, within = P.provider(config), P.limits(config)
        if most:
            within = P.Limits(min(most, within.chunks), within.tokens)
        for batch in batches:
            out = []
            for texts in _pieces(batch, within.chunks):
                some = [t for t in texts if t is not None]
                got = iter(P.embed_batches(source, some, within) if some else [])
                out.append(pa.array([None if t is None else next(got) for t in texts], pa.list_(pa.float32())))
            yield pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.float32()))

    return run(F.col(text) if isinstance(text, str) else text)


def try_embed(text: Column | str, config: dict, most: int | None = None) -> Column:
    """Structs of a vector or the error of its request; as ``embed`` else."""

    @F.arrow_udf("struct<value: array<float>, error: string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        source, within = P.provider(config), P.limits(config)
        if most:
            within = P.Limits(min(most, within.chunks), within.tokens)
        for batch in batches:
            vectors, errors = [], []
            for texts in _pieces(batch, within.chunks):
                some = [t for t in texts if t is not None]
                got = iter(P.embed_each(source, some, within) if some else [])
                rows = [(None, None) if t is None else next(got) for t in texts]
                vectors.append(pa.array([v for v, _ in rows], pa.list_(pa.float32())))
                errors.append(pa.array([e for _, e in rows], pa.string()))
            both = [pa.concat_arrays(vectors), pa.concat_arrays(errors)] if vectors else [pa.array([], pa.list_(pa.float32())), pa.array([], pa.string())]
            yield pa.StructArray.from_arrays(both, ["value", "error"])

    return run(F.col(text) if isinstance(text, str) else text)


def query_vector(text: str, config: dict, input_type: str = "query") -> list[float]:
    """A question's vector, asked for once on the driver."""
    own = dict(config)
    if config["implementation"] == "voyageai":
        own["input_type"] = input_type
    return [float(v) for v in P.provider(own).embed([text])[0]]


def call(request: Column | str, config: dict, task: str) -> Column:
    """A provider's answer (JSON) to a request (JSON)."""
    name = {"chat_complete": "chat"}.get(task, task)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        source = P.provider(config)
        for batch in batches:
            yield pa.array([None if r is None else json.dumps(source.call(name, json.loads(r))) for r in batch.to_pylist()], pa.string())

    return run(F.col(request) if isinstance(request, str) else request)


def chat_simple(prompt: Column | str, config: dict) -> Column:
    """The text of a chat's first choice."""
    p = F.col(prompt) if isinstance(prompt, str) else prompt
    message = F.array(F.struct(F.lit("user").alias("role"), p.alias("content")))
    return F.get_json_object(call(F.to_json(F.struct(F.lit(config.get("model")).alias("model"), message.alias("messages"))), config, "chat_complete"), "$.choices[0].message.content")


def moderation_status(flags: Column) -> Column:
    """approved / flagged, from a moderation's answer."""
    return F.when(F.get_json_object(flags, "$.results[0].flagged") == "true", "flagged").otherwise("approved")


def extract(answer: Column, schema: str) -> Column:
    """A model's JSON answer as a struct."""
    return F.from_json(answer, schema)


def anonymize(df: DataFrame, text_col: str, entities_col: str) -> Column:
    """Names of entities (array of struct name, type) replaced by ``[type]``, longest first, as whole words of any script in any case."""
    ordered = F.array_sort(F.col(entities_col), lambda a, b: F.coalesce(F.nullif(F.length(b["name"]) - F.length(a["name"]), F.lit(0)), F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)))
    quoted = lambda name: F.concat(F.lit(r"(?iu)(?<![\p{L}\p{M}\p{N}_])\Q"), name, F.lit(r"\E(?![\p{L}\p{M}\p{N}_])"))
    return F.aggregate(ordered, F.col(text_col), lambda acc, e: F.regexp_replace(acc, quoted(e["name"]), F.concat(F.lit("["), e["type"], F.lit("]"))))


def rerank(hits: DataFrame, query: str, text_col: str, config: dict, top_n: int | None = None) -> DataFrame:
    """``hits``, which are few, with the provider's relevance_score, best first; 0-based ``index`` in their order."""
    rows = hits.collect()
    answer = P.provider(config).call("rerank", {"model": config.get("model"), "query": query, "documents": [r[text_col] for r in rows], "top_n": top_n})
    spark = hits.sparkSession
    scores = [(int(x["index"]), float(x["relevance_score"])) for x in answer["results"]]
    left = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], ["index", *hits.columns]) if rows else hits.withColumn("index", F.lit(0))
    return left.join(spark.createDataFrame(scores, "index long, relevance_score double"), "index").orderBy(F.desc("relevance_score"), "index")


def client_config(**options) -> str:
    """Options that are set, as JSON."""
    return json.dumps({k: v for k, v in options.items() if v is not None}, sort_keys=True)


def _table_function(kind: str, task: str):
    """Rows of a provider's answer, as a table function."""
    name = task.removesuffix("_simple")

    class Rows:
        def eval(self, request: str):
            answer = P.provider({"implementation": kind}).call(name, json.loads(request or "{}"))
            if name == "rerank":
                for r in answer["results"]:
                    yield int(r["index"]), r.get("document"), float(r["relevance_score"])
            elif name == "classify":
                for r in answer["classifications"]:
                    yield r["input"], r["prediction"], float(r["confidence"])
            else:
                for m in answer.get("models") or answer.get("data") or []:
                    yield m.get("id") or m.get("name"), str(m.get("created") or m.get("created_at") or m.get("modified_at") or ""), m.get("owned_by")

    return Rows


def _embed_many(kind: str):
    class Rows:
        def eval(self, model: str, texts: list, dimensions: int):
            source = P.provider({"implementation": kind, "model": model, "dimensions": dimensions})
            for k, v in enumerate(P.embed_batches(source, list(texts or []), P.limits({"implementation": kind, "model": model or ""}))):
                yield k, [float(x) for x in v]

    return Rows


#: Columns of the table functions; fixed values.
ROWS = {"rerank_simple": "index int, document string, relevance_score double", "classify_simple": "input string, prediction string, confidence double", "models": "id string, created string, owned_by string"}


def table_functions() -> dict:
    """``ai_<provider>_rerank_simple``, ``_classify_simple``, ``_models`` (request) and ``_embed_many(model, texts, dimensions)``."""
    out = {}
    for kind, tasks in TASKS.items():
        for task, name in (("rerank", "rerank_simple"), ("classify", "classify_simple"), ("list_models", "models")):
            if task in tasks:
                out[f"ai_{kind}_{name}"] = F.udtf(_table_function(kind, task if name == "models" else name), returnType=ROWS[name])
        if kind != "anthropic":
            out[f"ai_{kind}_embed_many"] = F.udtf(_embed_many(kind), returnType="index int, embedding array<double>")
    return out


def register(spark: SparkSession) -> None:
    """``ai_<provider>_embed(model, text, dimensions)``, ``ai_<provider>_<task>(request)`` and the table functions."""
    for name, f in table_functions().items():
        spark.udtf.register(name, f)
    for kind in SQL_PROVIDERS:
        if kind != "anthropic":
            spark.udf.register(f"ai_{kind}_embed", _sql_embed(kind))
    for kind, tasks in TASKS.items():
        for task in tasks:
            spark.udf.register(f"ai_{kind}_{task}", _sql_call(kind, task))


def _sql_embed(kind: str):
    """Texts of an Arrow batch with the same model go in requests within the provider's limits."""

    def run(model: pa.Array, text: pa.Array, dimensions: pa.Array) -> pa.Array:
        rows = list(zip(model.to_pylist(), dimensions.to_pylist(), text.to_pylist(), strict=True))
        out: list = [None] * len(rows)
        for m, n in dict.fromkeys((m, n) for m, n, t in rows if t is not None):
            own = [k for k, r in enumerate(rows) if r[:2] == (m, n) and r[2] is not None]
            config = {"implementation": kind, "model": m, "dimensions": n}
            for k, v in zip(own, P.embed_batches(P.provider(config), [rows[k][2] for k in own], P.limits(config | {"model": m or ""})), strict=True):
                out[k] = [float(x) for x in v]
        return pa.array(out, pa.list_(pa.float64()))

    run.__annotations__ = {"model": pa.Array, "text": pa.Array, "dimensions": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<double>")


def _sql_call(kind: str, task: str):
    """A request a row, as the interface has it; the provider is made once a batch, and equal requests are sent once."""
    name = {"chat_complete": "chat"}.get(task, task)

    def run(request: pa.Array) -> pa.Array:
        source, rows = P.provider({"implementation": kind}), request.to_pylist()
        answers = {r: json.dumps(source.call(name, json.loads(r))) for r in dict.fromkeys(rows) if r is not None}
        return pa.array([answers.get(r) for r in rows], pa.string())

    run.__annotations__ = {"request": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")
