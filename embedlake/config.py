"""The pipeline's configuration: plain documents, checked against the source's schema when a plan is built."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import types as T

VERSION = "0.12.0"


class ConfigError(ValueError):
    """A configuration that no plan can be built from."""


def _config(config_type: str, implementation: str, **values: Any) -> dict:
    return {"implementation": implementation, "config_type": config_type} | {k: v for k, v in values.items() if v is not None}


def chunking_none() -> dict:
    return _config("chunking", "none")


def chunking_character_text_splitter(chunk_size: int = 800, chunk_overlap: int = 400, separator: str = "\n\n", is_separator_regex: bool = False) -> dict:
    return _config("chunking", "character_text_splitter", chunk_size=chunk_size, chunk_overlap=chunk_overlap, separator=separator, is_separator_regex=is_separator_regex)


def chunking_recursive_character_text_splitter(chunk_size: int = 800, chunk_overlap: int = 400, separators: list[str] | None = None, is_separator_regex: bool = False) -> dict:
    from embedlake.operators.chunk import SEPARATORS

    return _config("chunking", "recursive_character_text_splitter", chunk_size=chunk_size, chunk_overlap=chunk_overlap, separators=list(separators or SEPARATORS), is_separator_regex=is_separator_regex)


def formatting_python_template(template: str = "$chunk") -> dict:
    return _config("formatting", "python_template", template=template)


def formatting_chunk_value() -> dict:
    return _config("formatting", "chunk_value")


def scheduling_none() -> dict:
    return _config("scheduling", "none")


def scheduling_default() -> dict:
    return _config("scheduling", "default")


def scheduling_periodic(schedule_interval: str = "5m", initial_start: str | None = None, fixed_schedule: bool | None = None, timezone: str | None = None) -> dict:
    return _config("scheduling", "periodic", schedule_interval=schedule_interval, initial_start=initial_start, fixed_schedule=fixed_schedule, timezone=timezone)


def embedding_openai(model: str, dimensions: int, chat_user: str | None = None, api_key_name: str = "OPENAI_API_KEY", base_url: str | None = None) -> dict:
    return _config("embedding", "openai", model=model, dimensions=dimensions, user=chat_user, api_key_name=api_key_name, base_url=base_url)


def embedding_ollama(model: str, dimensions: int, base_url: str | None = None, options: dict | None = None, keep_alive: str | None = None) -> dict:
    return _config("embedding", "ollama", model=model, dimensions=dimensions, base_url=base_url, options=options, keep_alive=keep_alive)


def embedding_voyageai(model: str, dimensions: int, input_type: str = "document", api_key_name: str = "VOYAGE_API_KEY", output_dimension: int | None = None, output_dtype: str | None = None) -> dict:
    if input_type not in (None, "query", "document"):
        raise ConfigError('"input_type" must be null, "query", or "document"')
    return _config("embedding", "voyageai", model=model, dimensions=dimensions, input_type=input_type, api_key_name=api_key_name, output_dimension=output_dimension, output_dtype=output_dtype)


def embedding_litellm(model: str, dimensions: int, api_key_name: str | None = None, extra_options: dict | None = None) -> dict:
    return _config("embedding", "litellm", model=model, dimensions=dimensions, api_key_name=api_key_name, extra_options=extra_options)


def embedding_sentence_transformers(model: str = "nomic-ai/nomic-embed-text-v1.5", dimensions: int = 768) -> dict:
    return _config("embedding", "sentence_transformers", model=model, dimensions=dimensions)


def embedding_hash(dimensions: int) -> dict:
    """Deterministic vectors from digests of the text; needs no provider."""
    return _config("embedding", "hash", model="md5", dimensions=dimensions)


def indexing_none() -> dict:
    return _config("indexing", "none")


def indexing_default() -> dict:
    return _config("indexing", "default")


def indexing_diskann(min_rows: int = 100_000, storage_layout: str | None = None, num_neighbors: int | None = None, search_list_size: int | None = None, max_alpha: float | None = None, num_dimensions: int | None = None, num_bits_per_dimension: int | None = None, create_when_queue_empty: bool = True) -> dict:
    return _config("indexing", "diskann", min_rows=min_rows, storage_layout=storage_layout, num_neighbors=num_neighbors, search_list_size=search_list_size, max_alpha=max_alpha, num_dimensions=num_dimensions, num_bits_per_dimension=num_bits_per_dimension, create_when_queue_empty=create_when_queue_empty)


def indexing_hnsw(min_rows: int = 100_000, opclass: str = "vector_cosine_ops", m: int | None = None, ef_construction: int | None = None, create_when_queue_empty: bool = True) -> dict:
    return _config("indexing", "hnsw", min_rows=min_rows, opclass=opclass, m=m, ef_construction=ef_construction, create_when_queue_empty=create_when_queue_empty)


def processing_default(batch_size: int | None = None, concurrency: int | None = None) -> dict:
    return _config("processing", "default", batch_size=batch_size, concurrency=concurrency)


def grant_to(*grantees: str, default: str = "") -> list[str]:
    """Grantees with those of the comma-separated ``default``, without repeats."""
    return sorted({g for g in (*grantees, *(x.strip() for x in default.split(","))) if g})


def loading_column(column_name: str, retries: int = 6) -> dict:
    return _config("loading", "column", column_name=column_name, retries=retries)


def loading_uri(column_name: str, retries: int = 6, aws_role_arn: str | None = None) -> dict:
    return _config("loading", "uri", column_name=column_name, retries=retries, aws_role_arn=aws_role_arn)


def parsing_auto() -> dict:
    return _config("parsing", "auto")


def parsing_none() -> dict:
    return _config("parsing", "none")


def parsing_pymupdf() -> dict:
    return _config("parsing", "pymupdf")


def parsing_docling() -> dict:
    return _config("parsing", "docling")


def destination_table(destination: str | None = None, target_schema: str | None = None, target_table: str | None = None, view_schema: str | None = None, view_name: str | None = None) -> dict:
    return _config("destination", "table", destination=destination, target_schema=target_schema, target_table=target_table, view_schema=view_schema, view_name=view_name)


def destination_column(embedding_column: str) -> dict:
    return _config("destination", "column", embedding_column=embedding_column)


#: Implementations by kind of configuration, and how the message about another one reads.
KINDS = {
    "chunking": (("character_text_splitter", "recursive_character_text_splitter", "none"), "invalid chunking config implementation", "invalid chunking config implementation"),
    "formatting": (("python_template", "chunk_value"), "unrecognized formatting implementation", "unrecognized formatting implementation"),
    "scheduling": (("none", "periodic"), "scheduling implementation not specified", 'unrecognized scheduling implementation: "{}"'),
    "embedding": (("openai", "ollama", "voyageai", "litellm", "sentence_transformers", "hash"), "embedding implementation not specified", 'invalid embedding implementation: "{}"'),
    "indexing": (("none", "diskann", "hnsw"), "indexing implementation not specified", 'invalid indexing implementation: "{}"'),
    "processing": (("default",), "processing implementation not specified", 'unrecognized processing implementation: "{}"'),
    "loading": (("column", "uri"), "invalid loading config implementation", "invalid loading config implementation"),
    "parsing": (("auto", "none", "pymupdf", "docling"), "invalid parsing config implementation", "invalid parsing config implementation"),
    "destination": (("table", "column"), "invalid implementation for destination config", "invalid implementation for destination config"),
}
STORAGE_LAYOUTS = ("memory_optimized", "plain")
#: The L2 class is allowed too, as documented.
OPCLASSES = ("vector_ip_ops", "vector_cosine_ops", "vector_l1_ops", "vector_l2_ops")
ROLE_ARN = re.compile(r"arn:aws:iam::.*:role/.*", re.S)


def _base(kind: str, config: Any) -> str:
    if not isinstance(config, dict):
        raise ConfigError(f"{kind} configuration has to be a dictionary")
    if config.get("config_type") != kind:
        raise ConfigError(f"invalid config_type for {kind} config")
    known, missing, other = KINDS[kind]
    found = config.get("implementation")
    if found not in known:
        raise ConfigError(missing if found is None else other.format(found))
    return found


def _number(config: dict, name: str, most: int) -> None:
    value = config.get(name)
    if value is None:
        return
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ConfigError(f"{name} must be a number")
    if value > most:
        raise ConfigError(f"{name} must be less than or equal to {most}")
    if value < 1:
        raise ConfigError(f"{name} must be greater than 0")


def validate(kind: str, config: Any, schema: T.StructType | None = None, loading: dict | None = None, chunking: dict | None = None) -> None:
    """Raises ConfigError unless ``config`` is a valid ``kind`` for a source with ``schema``."""
    found = _base(kind, config)
    if kind == "processing":
        _number(config, "batch_size", 2048)
        _number(config, "concurrency", 50)
    elif kind == "indexing":
        if found == "diskann" and config.get("storage_layout") not in (None, *STORAGE_LAYOUTS):
            raise ConfigError("invalid storage_layout")
        if found == "hnsw" and config.get("opclass") not in (None, *OPCLASSES):
            raise ConfigError("invalid opclass")
    elif kind == "formatting" and found == "python_template":
        if "$chunk" not in (config.get("template") or ""):
            raise ConfigError("template must contain $chunk placeholder")
        if schema is not None and "chunk" in schema.names:
            raise ConfigError('formatting_python_template may not be used when source table has a column named "chunk"')
    elif kind == "loading":
        _loading(config, found, schema)
    elif kind == "parsing" and schema is not None and loading is not None:
        binary = isinstance(schema[loading["column_name"]].dataType, T.BinaryType)
        if found == "none" and binary:
            raise ConfigError("a binary column needs a parser, parsing_none has none")
        if loading["implementation"] == "column" and found in ("pymupdf", "docling") and not binary:
            raise ConfigError(f"parsing_{found} reads binary columns only")
    elif kind == "destination" and found == "column" and chunking is not None and chunking.get("implementation") != "none":
        raise ConfigError("chunking must be none for column destination")


def _loading(config: dict, found: str, schema: T.StructType | None) -> None:
    name, retries = config.get("column_name"), config.get("retries")
    if name is None:
        raise ConfigError("invalid loading config, missing column_name")
    if not isinstance(retries, int) or retries < 0:
        raise ConfigError("invalid loading config, retries must be a non-negative integer")
    role = config.get("aws_role_arn")
    if role is not None and not ROLE_ARN.fullmatch(role):
        raise ConfigError("invalid loading config, aws_role_arn must match arn:aws:iam::*:role/*")
    if schema is None:
        return
    if name not in schema.names:
        raise ConfigError(f"column_name in config does not exist in the table: {name}")
    kind = schema[name].dataType
    text = isinstance(kind, (T.StringType, T.VarcharType, T.CharType))
    if not text and not isinstance(kind, T.BinaryType):
        raise ConfigError(f"column_name {name} in config has type {kind.simpleString()}; string, varchar, char and binary can be loaded")
    if found == "uri" and not text:
        raise ConfigError(f"URIs are read from string columns, and {name} is none")


def resolve(config: dict, defaults: dict[str, str] | None = None) -> dict:
    """``config`` with a default indexing or scheduling replaced by the one that the settings name."""
    settings = defaults or {}
    if config.get("implementation") != "default" or config.get("config_type") not in ("indexing", "scheduling"):
        return config
    named = {"indexing_diskann": indexing_diskann, "indexing_hnsw": indexing_hnsw, "scheduling_periodic": scheduling_periodic}
    kind = config["config_type"]
    maker = named.get(settings.get(f"{kind}_default", ""))
    return maker() if maker else _config(kind, "none")


def evaluate_destination(config: dict, source_schema: str, source_table: str) -> dict:
    """The destination with all names; names that the user gives are kept, the view's schema among them."""
    if config.get("implementation") == "column":
        return _config("destination", "column", embedding_column=config["embedding_column"])
    if config.get("implementation") != "table":
        raise ConfigError("invalid implementation for destination config")
    own = config.get("destination")
    return _config(
        "destination", "table", target_schema=config.get("target_schema") or source_schema,
        target_table=config.get("target_table") or (f"{own}_store" if own else f"{source_table}_embedding_store"),
        view_schema=config.get("view_schema") or source_schema, view_name=config.get("view_name") or own or f"{source_table}_embedding",
    )


def vectorizer(
    source: str, schema: T.StructType, keys: list[str], loading: dict, embedding: dict, destination: dict | None = None, parsing: dict | None = None, chunking: dict | None = None,
    indexing: dict | None = None, formatting: dict | None = None, scheduling: dict | None = None, processing: dict | None = None, name: str | None = None, settings: dict | None = None,
) -> dict:
    """A whole configuration with defaults filled in, checked against the source."""
    if embedding is None:
        raise ConfigError("embedding configuration is required")
    if loading is None:
        raise ConfigError("loading configuration is required")
    if not keys or any(k not in schema.names for k in keys):
        raise ConfigError("source table must have a primary key constraint")
    if "dimensions" not in embedding:
        raise ConfigError("dimensions argument is required")
    out = {
        "version": VERSION, "loading": loading, "parsing": parsing or parsing_auto(), "embedding": embedding, "chunking": chunking or chunking_recursive_character_text_splitter(),
        "indexing": resolve(indexing or indexing_default(), settings), "formatting": formatting or formatting_python_template(), "scheduling": resolve(scheduling or scheduling_default(), settings),
        "processing": processing or processing_default(), "destination": destination or destination_table(),
    }
    for kind in KINDS:
        validate(kind, out[kind], schema, out["loading"], out["chunking"])
    if out["scheduling"]["implementation"] == "none" and out["indexing"]["implementation"] != "none":
        raise ConfigError("automatic indexing is not supported without scheduling. use indexing_none() with scheduling_none()")
    space, _, table = source.rpartition(".")
    out["destination"] = evaluate_destination(out["destination"], space or "default", table)
    where = out["destination"]
    out |= {"source": source, "keys": [f.name for f in schema if f.name in keys], "name": name or "_".join([space or "default", where["embedding_column"] and f"{table}_{where['embedding_column']}" if where["implementation"] == "column" else where["target_table"]])}
    return out


def to_json(config: dict) -> str:
    return json.dumps(config, sort_keys=True)


def from_json(text: str) -> dict:
    return migrate(json.loads(text))


def migrate(config: dict) -> dict:
    """A configuration of an older version in today's form: the loaded column moves out of the chunking."""
    out = json.loads(json.dumps(config))
    number = tuple(int(x) for x in re.findall(r"\d+", out.get("version", "0"))[:3])
    if number < (0, 10, 0):
        column = out.get("chunking", {}).pop("chunk_column", None)
        if "loading" not in out and column is not None:
            out["loading"] = loading_column(column)
        out.setdefault("parsing", parsing_auto())
        if "destination" not in out:
            out["destination"] = _config("destination", "table", **{k: out.pop(k) for k in ("target_schema", "target_table", "view_schema", "view_name") if k in out})
    out["version"] = VERSION
    return out


def executions(pending: int) -> int:
    """How many workers a scheduled run starts for so many waiting rows."""
    return min(-(-min(pending, 501) // 50), 10)


def create_call(config: dict) -> str:
    """The configuration as a readable call in SQL."""
    shown = lambda v: "'" + json.dumps(v, sort_keys=True).replace("'", "''") + "'" if isinstance(v, dict) else "'" + str(v).replace("'", "''") + "'"
    args = [f"{k} => {shown(config[k])}" for k in ("name", *KINDS) if k in config]
    return f"SELECT ai_create_vectorizer('{config['source']}', " + ", ".join(args) + ")"
