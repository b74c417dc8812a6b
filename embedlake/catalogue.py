"""The library's queries over the test tables, and SQL for DuckDB with the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from embedlake import config as C
from embedlake.functions import models, providers
from embedlake.functions import vector as V
from embedlake.functions.template import format_column
from embedlake.operators import ann, chunk, codes, ivf, knn, sampling
from embedlake.operators.words import WordIndex, fused
from embedlake.plans import cdc
from embedlake.plans.pipeline import Pipeline, embedding_view, plan, with_column
from embedlake.semantic.catalog import Catalog, content
from embedlake.session import shared_dir
from embedlake.sources import dataset, loading
from embedlake.semantic import keys, renames
from embedlake.streaming import worker
from embedlake.streaming.worker import windowed_counts

#: The query vector of the single-query searches: component i is (i % 7 - 3) / 3.
QUERY = [(i % 7 - 3) / 3 for i in range(64)]
Q = "(SELECT list_transform(range(64), lambda i: (i % 7 - 3) / 3.0::DOUBLE))"
E64 = "embedding::DOUBLE[]"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _topk(spark: SparkSession, d: str, metric: str, **more) -> DataFrame:
    found = knn.top_k(table(spark, d, "embeddings"), QUERY, 10, ["vec_id"], metric=metric, **more)
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


def _topk_sql(distance: str, where: str = "true") -> str:
    return f"SELECT vec_id, round({distance}, 6) AS distance FROM embeddings WHERE embedding IS NOT NULL AND {where} ORDER BY {distance}, vec_id LIMIT 10"


COSINE = f"list_cosine_distance({E64}, {Q})"


@query(_topk_sql(COSINE))
def vec_cosine_topk(spark, d):
    return _topk(spark, d, "vector_cosine_ops")


@query(_topk_sql(f"list_distance({E64}, {Q})"))
def vec_l2_topk(spark, d):
    return _topk(spark, d, "vector_l2_ops")


@query(_topk_sql(f"list_negative_inner_product({E64}, {Q})"))
def vec_ip_topk(spark, d):
    return _topk(spark, d, "vector_ip_ops")


@query(_topk_sql(f"list_sum(list_transform(list_zip({E64}, {Q}), lambda x: abs(x[1] - x[2])))"))
def vec_l1_topk(spark, d):
    return _topk(spark, d, "vector_l1_ops")


@query(_topk_sql(COSINE, "label = 3"))
def vec_filter_label(spark, d):
    return _topk(spark, d, "vector_cosine_ops", where="label = 3")


@query(_topk_sql(COSINE, "vec_id NOT IN (1, 2, 3, 5, 8, 13, 21)"))
def vec_exclude_ids(spark, d):
    return _topk(spark, d, "vector_cosine_ops", exclude=[1, 2, 3, 5, 8, 13, 21])


@query(f"SELECT vec_id, label, round({COSINE}, 6) AS distance FROM embeddings WHERE {COSINE} <= 0.9")
def vec_threshold(spark, d):
    e = table(spark, d, "embeddings").withColumn("distance", V.cosine_distance("embedding", QUERY))
    return e.where("distance <= 0.9").select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query("""
    WITH p AS (SELECT a.vec_id AS query_vec_id, b.vec_id, list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist
               FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_vec_id ORDER BY dist, vec_id) AS rn FROM p)
    SELECT query_vec_id, vec_id, round(dist, 6) AS distance, rn::INT AS rank FROM r WHERE rn <= 5""")
def vec_batch_knn(spark, d):
    e = table(spark, d, "embeddings")
    found = knn.batch_top_k(e, e.where("vec_id % 20 = 0"), 5, "vec_id", "vec_id", skip_same=True)
    return found.withColumn("distance", F.round("distance", 6))


@query("""
    WITH p AS (SELECT a.vec_id AS q, a.label AS ql, b.label AS bl, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rn
               FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
    SELECT ql AS label, round(avg(CASE WHEN ql = bl THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, count(*) AS n_queries FROM p WHERE rn = 1 GROUP BY ql""")
def vec_hit_rate_by_label(spark, d):
    e = table(spark, d, "embeddings")
    near = knn.batch_top_k(e, e.where("vec_id % 20 = 0"), 1, "vec_id", "vec_id", skip_same=True)
    named = near.join(e.select("vec_id", F.col("label").alias("near_label")), "vec_id")
    own = e.select(F.col("vec_id").alias("query_vec_id"), "label")
    hit = F.avg((F.col("label") == F.col("near_label")).cast("double"))
    return named.join(own, "query_vec_id").groupBy("label").agg(F.round(hit, 6).alias("hit_rate"), F.count("*").alias("n_queries"))


@query("SELECT label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))), 6) AS mean_norm, round(max(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))), 6) AS max_norm FROM embeddings GROUP BY label")
def vec_norm_stats(spark, d):
    e = table(spark, d, "embeddings").select("label", V.norm("embedding").alias("n"))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("n"), 6).alias("mean_norm"), F.round(F.max("n"), 6).alias("max_norm"))


@query("SELECT label, pos, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding)))::INT AS pos FROM embeddings) GROUP BY label, pos")
def vec_centroid_by_label(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query()
def vec_ivf_search(spark, d):
    """Approximate search by cells for every twentieth vector; its recall is measured in the tests."""
    path = _scratch(spark, "ivf")
    e = table(spark, d, "embeddings")
    ivf.build(e, path)
    found = ivf.search_many(spark, path, e.where("vec_id % 20 = 0"), 10, "vec_id", "vec_id")
    return found.select(F.col("query_id").alias("query_vec_id"), "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query()
def vec_graph_search(spark, d):
    """Search by graphs in cells for every twentieth vector; recall, and what the parameters do, are measured in the tests."""
    e, index = table(spark, d, "embeddings"), ann.Index(spark, _scratch(spark, "graph"), ["vec_id"])
    index.build(e)
    found = index.search_many(e.where("vec_id % 20 = 0"), 10, "vec_id")
    return found.select(F.col("query_id").alias("query_vec_id"), "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query()
def vec_graph_changes(spark, d):
    """The same after a segment in which some vectors are replaced by others' and some are gone; tests compare with exact search."""
    e, index = table(spark, d, "embeddings"), ann.Index(spark, _scratch(spark, "graph"), ["vec_id"])
    index.build(e)
    index.upsert(e.where("vec_id % 7 = 1").withColumn("embedding", F.reverse("embedding")), e.where("vec_id % 11 = 2").select("vec_id"))
    found = index.search_many(e.where("vec_id % 20 = 0"), 10, "vec_id")
    return found.select(F.col("query_id").alias("query_vec_id"), "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query(f"""
    WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
    c AS (SELECT vec_id, unnest(e) AS x, unnest(range(64)) AS i FROM x),
    t AS (SELECT i, (i % 7 - 3) / 3.0::DOUBLE AS q, round(avg(x) + stddev_pop(x) * -0.4307272992954576, 6) AS a, round(avg(x) + stddev_pop(x) * 0.4307272992954576, 6) AS b FROM c GROUP BY i),
    h AS (SELECT vec_id, sum(((x > a) <> (q > a))::INT + ((x > b) <> (q > b))::INT) AS bits FROM c JOIN t USING (i) GROUP BY vec_id),
    near AS (SELECT vec_id FROM h ORDER BY bits, vec_id LIMIT 100)
    SELECT vec_id, round({COSINE}, 6) AS distance FROM embeddings WHERE vec_id IN (SELECT vec_id FROM near) ORDER BY {COSINE}, vec_id LIMIT 10""")
def vec_code_topk(spark, d):
    """Codes of two bits a dimension, scanned by Hamming distance, and the exact ranking of the nearest hundred."""
    e = table(spark, d, "embeddings")
    cuts = codes.thresholds(e, bits=2)
    found = codes.search(e.withColumn("code", codes.code("embedding", cuts)), QUERY, cuts, 10, ["vec_id"], candidates=100)
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


MD5_4 = "round(((('0x' || substr(md5(coalesce(text, '') || ':0'), 1, 8))::UBIGINT / 2147483647.5::DOUBLE) - 1)::FLOAT::DOUBLE, 4)"


def _none_config(schema) -> dict:
    return C.vectorizer("default.documents", schema, ["doc_id"], C.loading_column("text"), C.embedding_hash(8), chunking=C.chunking_none(), formatting=C.formatting_python_template("$chunk"))


def _store(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    return plan(docs, _none_config(docs.schema))


@query(f"SELECT doc_id, 0 AS chunk_seq, length(text) AS n_chunk, 8 AS n_dims, {MD5_4} AS e0 FROM documents WHERE coalesce(text, '') <> ''")
def emb_store_none(spark, d):
    return _store(spark, d).select("doc_id", "chunk_seq", F.length("chunk").cast("bigint").alias("n_chunk"), F.size("embedding").alias("n_dims"), F.round(F.col("embedding")[0].cast("double"), 4).alias("e0"))


@query(f"SELECT lang, source, count(*) AS n, round(min({MD5_4}), 4) AS least FROM documents WHERE coalesce(text, '') <> '' GROUP BY lang, source")
def emb_view_left_join(spark, d):
    docs = table(spark, d, "documents")
    view = embedding_view(_store(spark, d).drop("chunk"), docs, ["doc_id"])
    return view.groupBy("lang", "source").agg(F.count("*").alias("n"), F.round(F.min(F.round(F.col("embedding")[0].cast("double"), 4)), 4).alias("least"))


@query(f"SELECT doc_id, lang, CASE WHEN lang = 'en' AND coalesce(text, '') <> '' THEN {MD5_4} END AS e0 FROM documents")
def emb_column_dest(spark, d):
    docs = table(spark, d, "documents")
    new = plan(docs.where("lang = 'en'"), _none_config(docs.schema))
    return with_column(docs, new, ["doc_id"], "emb").select("doc_id", "lang", F.round(F.col("emb")[0].cast("double"), 4).alias("e0"))


def _scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _pipeline(spark, schema, **more) -> Pipeline:
    config = C.vectorizer("default.documents", schema, ["doc_id"], C.loading_column("text"), C.embedding_hash(8), chunking=C.chunking_none(), formatting=C.formatting_python_template("$chunk"), **more)
    return Pipeline(spark, config, _scratch(spark, "pipeline"))


@query(f"""
    SELECT doc_id, 0 AS chunk_seq, length(text) AS n_chunk, {MD5_4} AS e0
    FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0) WHERE coalesce(text, '') <> ''""")
def pipeline_changes(spark, d):
    """A pipeline's store after all documents, and then after a snapshot in which some changed and some are gone."""
    docs = table(spark, d, "documents")
    p = _pipeline(spark, docs.schema)
    p.run(docs)
    p.run(docs.where("doc_id % 11 <> 0").withColumn("text", F.expr("CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END")))
    return p.table("store").read().select("doc_id", "chunk_seq", F.length("chunk").cast("bigint").alias("n_chunk"), F.round(F.col("embedding")[0].cast("double"), 4).alias("e0"))


@query("SELECT 'default_documents_embedding_store' AS name, 0::BIGINT AS pending_items, false AS disabled, count(DISTINCT doc_id) AS success_count, 0::BIGINT AS error_count FROM documents")
def pipeline_status(spark, d):
    """What a pipeline says of itself after a run, with its progress."""
    docs = table(spark, d, "documents")
    p = _pipeline(spark, docs.schema)
    p.run(docs)
    done = p.table("progress").read().groupBy("name").agg(F.sum("success_count").alias("success_count"), F.sum("error_count").alias("error_count"))
    return p.status().select("name", "pending_items", "disabled").join(done, "name")


@query(f"SELECT doc_id, lang, CASE WHEN coalesce(text, '') <> '' THEN {MD5_4} END AS e0 FROM documents")
def pipeline_column(spark, d):
    """The rows that a pipeline keeps whose destination is a column."""
    docs = table(spark, d, "documents")
    p = _pipeline(spark, docs.schema, destination=C.destination_column("emb"))
    p.run(docs)
    return p.table("target").read().select("doc_id", "lang", F.round(F.col("emb")[0].cast("double"), 4).alias("e0"))


@query(f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN {MD5_4.replace('::FLOAT::DOUBLE', '')} END AS e0, CASE WHEN text IS NOT NULL THEN 3 END AS n_dims FROM documents")
def sql_embed(spark, d):
    """Vectors by the SQL function."""
    from embedlake.session import register_all

    register_all(spark)
    docs = table(spark, d, "documents").withColumn("e", F.expr("ai_hash_embed('m', text, 3)"))
    return docs.select("doc_id", F.round(F.col("e")[0], 4).alias("e0"), F.when(F.col("e").isNotNull(), F.size("e")).alias("n_dims"))


def _nations(spark, d) -> Catalog:
    c = Catalog(spark, _scratch(spark, "catalog"))
    c.add_embedding(C.embedding_hash(4))
    rows = table(spark, d, "nation").orderBy("n_nationkey").select(
        F.lit("table").alias("objtype"), F.lit("tpch").alias("schema_name"), F.lower("n_name").alias("name"), F.lit(None).cast("string").alias("column_name"),
        F.array().cast("array<string>").alias("args"), F.concat(F.lit("nation of region "), F.col("n_regionkey").cast("string")).alias("description"),
    )
    c.set_descriptions(rows)
    return c


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS id, lower(n_name) AS name, 1 + CASE WHEN n_regionkey = 3 THEN 1 ELSE 0 END AS rank FROM nation ORDER BY rank DESC, id LIMIT 20")
def catalog_words(spark, d):
    """Catalogue rows by words."""
    return _nations(spark, d).search_words("objects", ["region", "3"], 20).select("id", "name", "rank")


_HASH4 = "list_transform(range(4), lambda i: ((('0x' || substr(md5({} || ':' || i), 1, 8))::UBIGINT / 2147483647.5::DOUBLE) - 1){})"


@query(f"""
    WITH c AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS id, lower(n_name) AS name, 'tpch.' || lower(n_name) || ' nation of region ' || n_regionkey AS content FROM nation),
    s AS (SELECT id, name, list_cosine_distance({_HASH4.format('content', '::FLOAT::DOUBLE')}, {_HASH4.format("'which nation'", '')}) AS dist FROM c)
    SELECT id, name, round(dist, 5) AS distance FROM s ORDER BY dist, id LIMIT 7""")
def catalog_search(spark, d):
    """Catalogue rows by vector."""
    c = _nations(spark, d)
    c.vectorize("emb1")
    return c.search("objects", "emb1", "which nation", 7).select("id", "name", F.round("distance", 5).alias("distance"))


#: Greedy words of at most 80 characters. A chunk is a run of words; only lengths go through the reduction.
CHUNK_SQL = """
    WITH w AS (SELECT doc_id, lang, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
    l AS (SELECT doc_id, lang, ws, list_transform(ws, lambda x: {'n': length(x), 'first': []::BIGINT[]}) AS ls FROM w WHERE len(ws) > 0),
    r AS (SELECT doc_id, lang, ws, list_reduce(list_transform(ls, lambda x, i: {'n': x.n, 'first': [i]}), lambda acc, x:
        CASE WHEN acc.n + 1 + x.n <= 80 THEN {'n': acc.n + 1 + x.n, 'first': acc.first} ELSE {'n': x.n, 'first': list_concat(acc.first, x.first)} END) AS acc FROM l),
    u AS (SELECT doc_id, lang, ws, acc.first AS starts, unnest(range(1, len(acc.first) + 1)) AS k FROM r),
    c AS (SELECT doc_id, lang, k AS seq, array_to_string(ws[starts[k] : CASE WHEN k < len(starts) THEN starts[k + 1] - 1 ELSE len(ws) END], ' ') AS raw FROM u),
    t AS (SELECT doc_id, lang, seq, regexp_replace(regexp_replace(raw, '^\\s+', ''), '\\s+$', '') AS chunk FROM c)
"""


def _word_chunks(spark, d) -> DataFrame:
    return chunk.explode_chunks(table(spark, d, "documents"), "text", "character_text_splitter", chunk_size=80, chunk_overlap=0, separator=" ")


@query(CHUNK_SQL + "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1)::INT AS chunk_seq, chunk FROM t WHERE chunk <> ''")
def chunk_char_words(spark, d):
    return _word_chunks(spark, d).select("doc_id", "chunk_seq", "chunk")


@query(CHUNK_SQL + "SELECT lang, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, max(length(chunk)) AS longest FROM t WHERE chunk <> '' GROUP BY lang")
def chunk_counts_by_lang(spark, d):
    return _word_chunks(spark, d).groupBy("lang").agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"), F.max(F.length("chunk")).cast("bigint").alias("longest"))


@query()
def chunk_recursive(spark, d):
    """Recursive chunks with the defaults; a scan by hand checks them in the tests."""
    return chunk.explode_chunks(table(spark, d, "documents"), "text").select("doc_id", "chunk_seq", "chunk")


@query("SELECT doc_id, 'id ' || doc_id || ' [' || coalesce(lang, 'None') || '] costs $: ' || coalesce(text, '') AS formatted FROM documents")
def fmt_template(spark, d):
    docs = table(spark, d, "documents").withColumn("chunk", F.coalesce("text", F.lit("")))
    return docs.select("doc_id", format_column(docs, "id $doc_id [${lang}] costs $$: $chunk").alias("formatted"))


@query("SELECT doc_id, octet_length(encode(coalesce(text, ''))) * 0.25::DOUBLE AS tokens, octet_length(encode(coalesce(text, ''))) * 0.25 > 8191 AS truncated FROM documents")
def batch_token_estimate(spark, d):
    tokens = F.octet_length(F.coalesce("text", F.lit(""))) * 0.25
    return table(spark, d, "documents").select("doc_id", tokens.cast("double").alias("tokens"), (tokens > providers.OPENAI_CONTEXT).alias("truncated"))


def _changes(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("user_id", (F.col("event_id") % 8).cast("int").alias("loading_retries"), F.when(F.col("event_id") % 5 == 0, F.col("ts")).alias("loading_retry_after"))


CHANGES = "(SELECT user_id, (event_id % 8)::INT AS loading_retries, CASE WHEN event_id % 5 = 0 THEN ts END AS loading_retry_after FROM events)"


@query(f"SELECT user_id, max(loading_retries) AS loading_retries FROM {CHANGES} WHERE loading_retry_after IS NULL OR loading_retry_after < TIMESTAMP '2024-01-15' GROUP BY user_id")
def queue_dedupe(spark, d):
    return cdc.claim(_changes(spark, d), ["user_id"], F.lit("2024-01-15").cast("timestamp_ntz"))


@query(f"""
    SELECT event_id, 'retry' AS state, event_id % 8 + 1 AS retries, strftime(TIMESTAMP '2024-01-01' + to_minutes(3 * (event_id % 8 + 1)), '%Y-%m-%d %H:%M:%S') AS after FROM events WHERE event_id % 8 < 6
    UNION ALL SELECT event_id, 'dead', event_id % 8, NULL FROM events WHERE event_id % 8 >= 6""")
def queue_retry_split(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 8).alias("loading_retries"))
    again, dead = cdc.settle(e, ["event_id"], now=F.lit("2024-01-01").cast("timestamp"))
    a = again.select("event_id", F.lit("retry").alias("state"), F.col("loading_retries").alias("retries"), F.date_format("loading_retry_after", "yyyy-MM-dd HH:mm:ss").alias("after"))
    return a.unionByName(dead.select("event_id", F.lit("dead").alias("state"), (F.col("event_id") % 8).alias("retries"), F.lit(None).cast("string").alias("after")))


@query("SELECT CASE WHEN n > 10000 THEN 9223372036854775807 ELSE n END AS pending FROM (SELECT count(*) AS n FROM (SELECT 1 FROM events LIMIT 10001))")
def queue_pending_capped(spark, d):
    n = table(spark, d, "events").limit(cdc.PENDING_CAP + 1).agg(F.count("*").alias("n"))
    return n.select(F.when(F.col("n") > cdc.PENDING_CAP, cdc.PENDING_MANY).otherwise(F.col("n")).alias("pending"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'delete' WHEN o_orderkey % 7 = 0 THEN 'update' ELSE 'same' END AS op FROM orders
    UNION ALL SELECT o_orderkey + 100000000, 'insert' FROM orders WHERE o_orderkey % 13 = 0""")
def cdc_diff_ops(spark, d):
    old = table(spark, d, "orders")
    new = old.where("o_orderkey % 11 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    new = new.unionByName(old.where("o_orderkey % 13 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 100000000))
    return cdc.diff(old, new, ["o_orderkey"])


@query("SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def cdc_apply_latest(spark, d):
    return cdc.latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@query("SELECT e.event_id, c.c_name AS name FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey WHERE e.event_type = 'error'")
def errors_view_join(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    return e.join(table(spark, d, "customer"), e["user_id"] == F.col("c_custkey"), "left").select("event_id", F.col("c_name").alias("name"))


@query("SELECT user_id, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)::BIGINT AS success_count, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS error_count FROM events GROUP BY user_id")
def worker_progress_agg(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("success_count"), F.count_if(F.col("event_type") == "error").alias("error_count"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def dechunk_conversation(spark, d):
    return dataset.dechunk(table(spark, d, "conversations").where("text is not null"), ["conv_id"], "text", "turn")


@query(f"SELECT label, '[' || string_agg(vec_id::VARCHAR, ',' ORDER BY dist, vec_id) || ']' AS context FROM (SELECT label, vec_id, dist, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS rn FROM (SELECT label, vec_id, {COSINE} AS dist FROM embeddings)) WHERE rn <= 3 GROUP BY label")
def rag_context_agg(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id", V.cosine_distance("embedding", QUERY).alias("dist"))
    top = e.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("dist", "vec_id"))).where("rn <= 3")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("dist", "vec_id"))), lambda x: x["vec_id"])
    return top.groupBy("label").agg(F.to_json(ordered).alias("context"))


@query("SELECT doc_id, CASE WHEN lower(text) LIKE '%kill%' OR lower(text) LIKE '%hate%' OR lower(text) LIKE '%attack%' THEN 'flagged' ELSE 'approved' END AS status FROM documents WHERE text IS NOT NULL")
def moderate_rule(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    answer = models.call(F.to_json(F.struct(F.col("text").alias("input"))), {"implementation": "hash"}, "moderate")
    return docs.select("doc_id", models.moderation_status(answer).alias("status"))


@query("SELECT d.lang, CASE WHEN l.toxic = 1 THEN 'flagged' WHEN l.toxic = 0 THEN 'approved' ELSE 'pending' END AS status, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2")
def moderation_status_counts(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    status = F.when(F.col("toxic") == 1, "flagged").when(F.col("toxic") == 0, "approved").otherwise("pending")
    return docs.join(labels, "doc_id", "left").groupBy("lang", status.alias("status")).agg(F.count("*").alias("n"))


@query("""
    WITH q AS (SELECT list_distinct(string_split(lower('the of and to in'), ' ')) AS ws),
    s AS (SELECT item_id, len(list_intersect(ws, string_split(lower(text), ' ')))::DOUBLE / len(ws) AS relevance_score FROM benchmark, q)
    SELECT item_id, round(relevance_score, 6) AS relevance_score FROM s ORDER BY relevance_score DESC, item_id LIMIT 10""")
def rerank_overlap(spark, d):
    ws = F.array(*[F.lit(w) for w in ("the", "of", "and", "to", "in")])
    score = F.size(F.array_intersect(ws, F.split(F.lower("text"), " "))) / F.size(ws)
    return knn.rerank(table(spark, d, "benchmark"), score, 10, ["item_id"]).select("item_id", F.round("relevance_score", 6).alias("relevance_score"))


@query("""
    SELECT lang, prediction, count(*) AS n FROM (SELECT lang, CASE WHEN (text LIKE '% der %' OR text LIKE '% und %') THEN 'de' WHEN text LIKE '% les %' OR text LIKE '% le %' THEN 'fr'
        WHEN text LIKE '% los %' OR text LIKE '% el %' THEN 'es' ELSE 'en' END AS prediction FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2""")
def classify_lang_rule(spark, d):
    has = lambda *w: F.col("text").rlike("|".join(f" {x} " for x in w))
    guess = F.when(has("der", "und"), "de").when(has("les", "le"), "fr").when(has("los", "el"), "es").otherwise("en")
    return table(spark, d, "documents").where("text is not null").groupBy("lang", guess.alias("prediction")).agg(F.count("*").alias("n"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages WHERE html IS NOT NULL")
def extract_title(spark, d):
    return table(spark, d, "pages").where("html is not null").select("page_id", loading.title("html").alias("title"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)<a\\s[^>]*href'))::INT AS n_links FROM pages WHERE html IS NOT NULL")
def html_links_count(spark, d):
    return table(spark, d, "pages").where("html is not null").select("page_id", F.regexp_count("html", F.lit(r"(?i)<a\s[^>]*href")).alias("n_links"))


@query()
def html_text(spark, d):
    """Visible text of pages, parsed as documents."""
    pages = table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    text = F.arrow_udf(_arrow_text, "string")
    return pages.select("page_id", text("content").alias("text"))


def _arrow_text(batch: pa.Array) -> pa.Array:
    return pa.array([None if x is None else loading.parse_document(x, "html") for x in batch.to_pylist()], pa.string())


@query("SELECT page_id, nullif(lower(regexp_extract(regexp_extract(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*|[?#].*$', '', 'g'), '[^/]*$'), '[^.]\\.([^.]+)$', 1)), '') AS ext FROM pages")
def filetype_sniff(spark, d):
    return table(spark, d, "pages").select("page_id", loading.extension("url").alias("ext"))


@query("SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY md5(text)")
def dedupe_exact(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props_extract(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey AS id, 'tpch.' || lower(n_name) || CASE WHEN n_nationkey % 2 = 0 THEN '(int, text)' ELSE '' END || ' nation of region ' || n_regionkey AS content FROM nation")
def catalog_content_rule(spark, d):
    rows = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("id"), F.lit("tpch").alias("schema_name"), F.lower("n_name").alias("name"), F.lit(None).cast("string").alias("column_name"),
        F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("int"), F.lit("text"))).otherwise(F.array().cast("array<string>")).alias("args"), F.concat(F.lit("nation of region "), F.col("n_regionkey").cast("string")).alias("description"),
    )
    return rows.select("id", content("objects").alias("content"))


@query("SELECT c_custkey, count(*) AS usage FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey ORDER BY usage DESC, c_custkey LIMIT 20")
def usage_topn(spark, d):
    used = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey").agg(F.count("*").alias("usage"))
    return used.orderBy(F.desc("usage"), "c_custkey").limit(20)


@query(f"""
    SELECT vec_id AS id FROM (SELECT vec_id FROM embeddings ORDER BY {COSINE}, vec_id LIMIT 20)
    UNION SELECT doc_id FROM (SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\\blicense\\b') ORDER BY doc_id LIMIT 20)""")
def hybrid_union(spark, d):
    near = knn.top_k(table(spark, d, "embeddings"), QUERY, 20, ["vec_id"]).select(F.col("vec_id").alias("id"))
    words = table(spark, d, "documents").where(F.col("text").rlike(r"(?i)\blicense\b")).orderBy("doc_id").limit(20).select(F.col("doc_id").alias("id"))
    return near.union(words).distinct()


@query("""
    WITH p AS (SELECT a.vec_id AS q, a.vec_id % 5 AS question_type, b.vec_id AS hit, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rn
               FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
    h AS (SELECT q, question_type, max(CASE WHEN rn <= 10 AND hit = q THEN 1.0 ELSE 0.0 END) AS found FROM p GROUP BY q, question_type)
    SELECT question_type, round(avg(found), 6) AS hit_rate, count(*) AS n_queries FROM h GROUP BY question_type""")
def hit_rate_by_type(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 20 = 0")
    found = knn.batch_top_k(e, asked, 10, "vec_id", "vec_id")
    truth = asked.select(F.col("vec_id").alias("query_vec_id"), "vec_id", (F.col("vec_id") % 5).alias("question_type"))
    out = knn.hit_rate(found, truth, "query_vec_id", ["vec_id"], ["question_type"])
    return out.withColumn("hit_rate", F.round("hit_rate", 6))


@query(f"""
    SELECT c_custkey, n_name, o_orderkey, round({COSINE}, 6) AS distance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN embeddings ON vec_id = c_custkey
    WHERE o_orderstatus = 'O' AND {COSINE} IS NOT NULL ORDER BY {COSINE}, o_orderkey LIMIT 25""")
def business_join_topk(spark, d):
    c, n, o, e = (table(spark, d, t) for t in ("customer", "nation", "orders", "embeddings"))
    joined = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(o.where("o_orderstatus = 'O'"), F.col("o_custkey") == F.col("c_custkey")).join(e, F.col("vec_id") == F.col("c_custkey"))
    return knn.top_k(joined, QUERY, 25, ["o_orderkey"]).select("c_custkey", "n_name", "o_orderkey", F.round("distance", 6).alias("distance"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_window(spark, d):
    out = windowed_counts(table(spark, d, "events"), "ts", "event_type", "value")
    return out.select(F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "event_type", "n", F.round("total", 4).alias("total"))


#: A word in any case between characters of no word; two words can share the one between them, so it is applied twice.
_WHOLE = r"'(?i)(^|[^\p{L}\p{M}\p{N}_])%s($|[^\p{L}\p{M}\p{N}_])', '\1[%s]\2', 'g')"
ANONYMIZE_SQL = "text"
for _name, _kind in (("thea", "LONG"), ("thea", "LONG"), ("the", "WORD"), ("the", "WORD")):
    ANONYMIZE_SQL = f"regexp_replace({ANONYMIZE_SQL}, {_WHOLE % (_name, _kind)}"


@query(f"SELECT item_id, {ANONYMIZE_SQL} AS text FROM benchmark")
def anonymize_entities(spark, d):
    found = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in (("the", "WORD"), ("thea", "LONG"))])
    b = table(spark, d, "benchmark").withColumn("entities", found)
    return b.select("item_id", models.anonymize(b, "text", "entities").alias("text"))


@query()
def pipeline_recursive(spark, d):
    """The whole chain with default chunking and a template, embedded offline."""
    docs = table(spark, d, "documents")
    config = C.vectorizer("default.documents", docs.schema, ["doc_id"], C.loading_column("text"), C.embedding_hash(16), formatting=C.formatting_python_template("title: $source $chunk"))
    return plan(docs, config).select("doc_id", "chunk_seq", F.length("chunk").alias("n_chars"), F.round(F.col("embedding")[0].cast("double"), 4).alias("e0"))


@query(f"""
    WITH c AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS id, lower(n_name) AS name, n_regionkey AS r, 'tpch.' || lower(n_name) || ' nation of region ' || n_regionkey AS content FROM nation),
    s AS (SELECT id, name, list_cosine_distance({_HASH4.format('content', '::FLOAT::DOUBLE')}, {_HASH4.format("'which nation'", '')}) AS dist FROM c WHERE r = 3)
    SELECT id, name, round(dist, 5) AS distance FROM s ORDER BY dist, id LIMIT 5""")
def catalog_allowed(spark, d):
    """The nearest objects among those that may be seen, of which there are fewer than near ones."""
    c = _nations(spark, d)
    c.vectorize("emb1")
    return c.search_owners("emb1", "which nation", 5, allowed=F.col("description") == "nation of region 3").select("id", "name", F.round("distance", 5).alias("distance"))


#: Scores of documents by words; {words} are those of the query.
WORDS_SQL = """
    t AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
    p AS (SELECT id, len(w) AS n, unnest(w) AS term FROM t),
    tf AS (SELECT id, n, term, count(*) AS tf FROM p WHERE term IN ({words}) GROUP BY id, n, term),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    m AS (SELECT count(*) AS texts, sum(len(w)) AS words FROM t),
    said AS (SELECT id, round(sum(ln(1 + (texts - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / (words::DOUBLE / texts)))), 6) AS score
             FROM tf JOIN df USING (term), m GROUP BY id)""".replace("\\\\", "\\")
ASKED = "Licensed under the terms of 2019"
ASKED_SQL = ", ".join(f"'{w}'" for w in ASKED.lower().split())


def _words(spark, d) -> WordIndex:
    index = WordIndex(spark, _scratch(spark, "words"))
    index.build(table(spark, d, "documents"), "doc_id", "text")
    return index


@query("WITH " + WORDS_SQL.format(words=ASKED_SQL) + "SELECT id AS doc_id, score FROM said ORDER BY score DESC, id LIMIT 25")
def words_ranked(spark, d):
    """Documents by words, from postings."""
    return _words(spark, d).search(ASKED, 25).withColumnRenamed("id", "doc_id")


@query("WITH " + WORDS_SQL.format(words=ASKED_SQL) + f""",
    a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM said ORDER BY score DESC, id LIMIT 40),
    b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {COSINE}, vec_id) AS r FROM embeddings WHERE embedding IS NOT NULL ORDER BY {COSINE}, vec_id LIMIT 40)
    SELECT id AS doc_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY score DESC, id LIMIT 20""")
def words_and_vectors(spark, d):
    """The fusion of a ranking by words with one by vectors of the same ids."""
    said = _words(spark, d).search(ASKED, 40).select("id", (-F.col("score")).alias("_by"))
    near = knn.top_k(table(spark, d, "embeddings"), QUERY, 40, ["vec_id"]).select(F.col("vec_id").alias("id"), F.col("distance").alias("_by"))
    return fused([said, near], "id", 20).withColumnRenamed("id", "doc_id")


@query("SELECT doc_id, lang FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100")
def sample_seeded(spark, d):
    """A hundred random documents."""
    return sampling.sample(table(spark, d, "documents"), 100, ["doc_id"], 7).select("doc_id", "lang")


@query("SELECT lang, source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY md5('3:' || doc_id), doc_id) <= 2")
def sample_by_source(spark, d):
    """Two random documents of each language and source."""
    return sampling.sample_by(table(spark, d, "documents"), 2, ["lang", "source"], ["doc_id"], 3).select("lang", "source", "doc_id")


#: Columns that can be keys, by type.
KEYABLE = {
    "INTEGER": ["region.r_regionkey", "nation.n_nationkey", "nation.n_regionkey", "customer.c_nationkey", "supplier.s_nationkey", "part.p_size"],
    "BIGINT": ["customer.c_custkey", "supplier.s_suppkey", "part.p_partkey", "orders.o_orderkey", "orders.o_custkey"],
    "VARCHAR": ["region.r_name", "nation.n_name", "customer.c_name", "customer.c_mktsegment", "supplier.s_name", "part.p_name", "part.p_brand", "part.p_type", "orders.o_orderstatus", "orders.o_orderpriority"],
}


def _keys_sql() -> str:
    unique = "(SELECT count(*) > 0 AND count(*) = count(DISTINCT {1}) FROM {0})"
    out = []
    for columns in KEYABLE.values():
        pairs = [c.split(".") for c in columns]
        out += [f"SELECT '{t}' AS tab, '{c}' AS col, NULL AS other, NULL AS other_col WHERE {unique.format(t, c)}" for t, c in pairs]
        out += [
            f"SELECT '{s}', '{x}', '{t}', '{y}' WHERE {unique.format(t, y)} AND EXISTS (SELECT 1 FROM {s} WHERE {x} IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM {s} ANTI JOIN {t} ON {s}.{x} = {t}.{y} WHERE {s}.{x} IS NOT NULL)"
            for s, x in pairs for t, y in pairs if s != t
        ]
    return " UNION ALL ".join(out)


@query(_keys_sql())
def keys_found(spark, d):
    """Unique columns, and columns whose values are all those of a unique one of another table."""
    names = sorted({c.split(".")[0] for columns in KEYABLE.values() for c in columns})
    tables = {n: table(spark, d, n) for n in names}
    unique, within = keys.found(tables)
    rows = [(n, c, None, None) for n, columns in unique.items() for c in columns] + within
    return spark.createDataFrame(rows, "tab string, col string, other string, other_col string")


@query(f"""
    SELECT doc_id, 0 AS chunk_seq, length(text) AS n_chunk, {MD5_4} AS e0
    FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0) WHERE coalesce(text, '') <> ''""")
def stream_changes(spark, d):
    """A pipeline's store behind a replayed stream of all documents, and of updates and deletions of some."""
    docs, path = table(spark, d, "documents").select("doc_id", "text"), _scratch(spark, "stream")
    p = _pipeline(spark, docs.schema)
    changed = docs.where("doc_id % 7 = 0 or doc_id % 11 = 0").select("doc_id", F.concat("text", F.lit("!")).alias("text"), F.when(F.col("doc_id") % 11 == 0, "delete").otherwise("update").alias("op"), F.lit(2).alias("version"))
    for log in (docs.select("*", F.lit("insert").alias("op"), F.lit(1).alias("version")), changed):  # one behind the other, to one checkpoint
        log.write.mode("append").parquet(f"{path}/log")
        worker.start(p, spark.readStream.schema(log.schema).parquet(f"{path}/log"), f"{path}/checkpoint", once=True).awaitTermination()
    return p.table("store").read().select("doc_id", "chunk_seq", F.length("chunk").cast("bigint").alias("n_chunk"), F.round(F.col("embedding")[0].cast("double"), 4).alias("e0"))


@query("SELECT doc_id, lang, source, length(text) AS n_text FROM documents")
def dataset_commits(spark, d):
    """All documents from files of at most 20,000 rows, loaded eight files a commit."""
    path, name = _scratch(spark, "dataset"), f"documents_{uuid.uuid4().hex}"
    table(spark, d, "documents").select("doc_id", "lang", "source", "text").write.option("maxRecordsPerFile", 20_000).parquet(path)
    dataset.load_dataset(spark, path, table=name, commit_every_n_batches=8)
    return spark.table(name).select("doc_id", "lang", "source", F.length("text").cast("bigint").alias("n_text"))


#: Relations before and after, with their keys; columns that have new names, of one type side by side.
MOVED = {"tpch.customer": ("shop.clients",), "tpch.orders": ("shop.sales",), "tpch.supplier": ("shop.vendors", "shop.vendors_copy")}
KEY = {"customer": "c_custkey", "orders": "o_orderkey", "supplier": "s_suppkey"}
RECALLED = {"customer": {"c_name": "full_name", "c_acctbal": "balance", "c_mktsegment": "segment"}, "orders": {"o_custkey": "buyer", "o_totalprice": "total", "o_orderpriority": "urgency"}}


def _renames_sql() -> str:
    same = "NOT EXISTS (SELECT {1} FROM {0} EXCEPT SELECT {3} FROM {2}) AND NOT EXISTS (SELECT {3} FROM {2} EXCEPT SELECT {1} FROM {0})"
    pairs = [(a, b, c, d) for a, olds in MOVED.items() for c, news in MOVED.items() for d in news for b in [a.rpartition(".")[2]]]
    relations = [f"SELECT '{a}' AS old, '{d}' AS new WHERE {same.format(b, KEY[b], c.rpartition('.')[2], KEY[c.rpartition('.')[2]])}" for a, b, c, d in pairs]
    columns = [
        f"SELECT '{MOVED['tpch.' + t][0]}' AS relation, 'rename' AS kind, '{x}' AS old, '{names[y]}' AS new WHERE (SELECT any_value(typeof({x})) = any_value(typeof({y})) FROM {t}) AND {same.format(t, x, t, y)}"
        for t, names in RECALLED.items() for x in names for y in names
    ]
    both = f"SELECT '' AS relation, CASE WHEN count(*) = 1 THEN 'rename' ELSE 'ambiguous' END AS kind, old, CASE WHEN count(*) = 1 THEN max(new) END AS new FROM ({' UNION ALL '.join(relations)}) GROUP BY old"
    return " UNION ALL ".join([both, *columns])


@query(_renames_sql())
def catalog_renames(spark, d):
    """Relations and columns under new names, and one relation of which there are two copies, by snapshots of their rows."""
    old = {a: table(spark, d, a.rpartition(".")[2]) for a in MOVED}
    new = {n: old[a].withColumnsRenamed(RECALLED.get(a.rpartition(".")[2], {})) for a, names in MOVED.items() for n in names}
    path = _scratch(spark, "renames")
    for side, tables in (("old", old), ("new", new)):
        renames.snapshot(spark, tables).write.parquet(f"{path}/{side}")
    before, after = spark.read.parquet(f"{path}/old"), spark.read.parquet(f"{path}/new")
    moved = renames.relations(before, after)
    own = renames.columns(before, after, moved.where("kind = 'rename'").select("old", "new"))
    return moved.select(F.lit("").alias("relation"), "kind", "old", "new").unionByName(own)
