import datetime
import random

import pytest
from pyspark.sql import functions as F

from embedlake import config as C
from embedlake.plans import cdc
from embedlake.plans.pipeline import Pipeline, embedding_view, plan
from embedlake.plans.store import Table
from embedlake.sources import dataset
from embedlake.streaming import worker


def blog(spark, rows):
    return spark.createDataFrame(rows, "id int, body string, note string")


def make(spark, folder, df, **more):
    config = C.vectorizer("default.blog", df.schema, ["id"], more.pop("loading", C.loading_column("body")), C.embedding_hash(4), chunking=C.chunking_character_text_splitter(10, 0, " "), **more)
    return Pipeline(spark, config, folder)


def shown(df):
    return sorted((r["id"], r["chunk_seq"], r["chunk"], tuple(r["embedding"])) for r in df.collect())


def test_incremental_equals_full(spark, folder):
    rnd, state = random.Random(3), {k: (f"post number {k} has words", "n") for k in range(12)}
    p = make(spark, f"{folder}/a", blog(spark, [(1, "x", "n")]))
    for step in range(3):
        df = blog(spark, [(k, *v) for k, v in state.items()])
        p.run(df)
        assert shown(p.table("store").read()) == shown(plan(df, p.config))
        for k in list(state):
            if rnd.random() < 0.3:
                state.pop(k)
            elif rnd.random() < 0.5:
                state[k] = (f"edited {step} {k}" if rnd.random() < 0.8 else "   ", "m")
        state[100 + step] = ("brand new text", None)
    view = embedding_view(p.table("store").read(), df, ["id"])
    assert set(view.columns) == {"id", "chunk_seq", "chunk", "embedding", "body", "note"}
    p.disabled = True
    assert p.run(df)["insert"] == 0
    assert p.status().first()["disabled"]


def test_loading_retries(spark, folder, tmp_path):
    df = spark.createDataFrame([(1, str(tmp_path / "none.txt"))], "id int, url string")
    p = make(spark, folder, df, loading=C.loading_uri("url", retries=2))
    t0 = datetime.datetime(2024, 1, 1)
    at = lambda m: F.lit(t0 + datetime.timedelta(minutes=m))
    p.run(df, at(0))
    q = p.table("queue").read().first()
    assert q["loading_retries"] == 1 and p.status().first()["pending_items"] == 1
    assert p.run(df, at(1))["retried"] == 0  # not due yet
    assert p.run(df, at(4))["retried"] == 1
    assert p.table("queue").read().first()["loading_retries"] == 2
    p.run(df, at(60))
    assert p.table("dead").read().first()["failure_step"] == "loading" and p.table("queue").read().count() == 0
    errors = [r["details"] for r in p.table("errors").read().collect()]
    assert sum('"is_retryable":false' in e for e in errors) == 1 and len(errors) == 3


def test_store(spark, folder):
    t = Table(spark, folder)
    t.write(spark.range(3).withColumn("v", F.lit("a")), 1)
    t.upsert(spark.createDataFrame([(1, "b")], "id long, v string"), ["id"], spark.createDataFrame([(2, "")], "id long, v string"), 2)
    t.upsert(spark.createDataFrame([(9, "z")], "id long, v string"), ["id"], None, 2)  # the same batch again
    assert sorted(tuple(r) for r in t.read().collect()) == [(0, "a"), (1, "b")]
    with pytest.raises(FileNotFoundError):
        Table(spark, f"{folder}/none").read()


def test_upsert_touches_its_buckets_only(spark, folder):
    t = Table(spark, folder, 64)
    t.write(spark.range(1000).withColumn("v", F.lit("a")), 1, ["id"])
    before = t._pointer()["parts"]
    t.upsert(spark.createDataFrame([(1, "b"), (5000, "c")], "id long, v string"), ["id"], spark.createDataFrame([(7,), (9999,)], "id long"), 2)
    after = t._pointer()["parts"]
    assert sum(before[b] != after.get(b) for b in before) <= 4
    rows = {r["id"]: r["v"] for r in t.read().collect()}
    assert len(rows) == 1000 and rows[1] == "b" and rows[5000] == "c" and 7 not in rows
    t.upsert(t.read().where("id < 3").withColumn("v", F.lit("d")), ["id"], None, 3)
    assert sorted(r["id"] for r in t.read().where("v = 'd'").collect()) == [0, 1, 2] and t.read().count() == 1000
    log = Table(spark, f"{folder}/log")
    for k in range(40):
        log.append(spark.range(k, k + 1))
    assert sorted(r[0] for r in log.read().collect()) == list(range(40)) and len(log._pointer()["parts"]) < 40


def test_column_destination_and_batch_size(spark, folder):
    df = blog(spark, [(1, "one", "n"), (2, "two", "n"), (3, "", "n")])
    config = C.vectorizer("default.blog", df.schema, ["id"], C.loading_column("body"), C.embedding_hash(4), chunking=C.chunking_none(), destination=C.destination_column("vec"), processing=C.processing_default(batch_size=1))
    p = Pipeline(spark, config, folder)
    p.run(df)
    got = {r["id"]: r["vec"] for r in p.table("target").read().collect()}
    assert got[1] and got[2] and got[1] != got[2] and got[3] is None
    p.run(blog(spark, [(1, "new", "n"), (3, "", "n")]))
    now = {r["id"]: (r["body"], r["vec"]) for r in p.table("target").read().collect()}
    assert set(now) == {1, 3} and now[1][0] == "new" and now[1][1] != got[1]


def test_registry(spark, folder):
    from embedlake.plans.registry import Registry

    df = blog(spark, [(1, "one", "n")])
    r = Registry(spark, folder)
    config = make(spark, folder, df).config
    number = r.create(config)
    with pytest.raises(ValueError, match="exists"):
        r.create(config)
    assert r.create(config, if_not_exists=True) == number and r.list().count() == 1
    r.get(number).run(df)
    Registry(spark, folder).disable(config["name"])
    again = Registry(spark, folder).get(number)
    assert again.disabled and again.run(blog(spark, []))["delete"] == 0 and again.table("store").read().count() == 1
    r.enable(number)
    assert r.get(config["name"]).run(blog(spark, []))["delete"] == 1
    r.drop(number, drop_all=True)
    assert r.list().count() == 0
    with pytest.raises(KeyError):
        r.get(number)


def test_state_tells_nulls_apart(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, "x", "y")], "id int, v string, w string")
    b = spark.createDataFrame([(1, "x", None), (2, "x", "y")], "id int, v string, w string")
    assert {r["id"]: r["op"] for r in cdc.diff_state(cdc.state_of(a, ["id"]), b, ["id"]).collect()} == {1: "update", 2: "same"}


def test_cdc(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1), (3, None, 1)], "id int, v string, emb int")
    b = spark.createDataFrame([(1, "x", 2), (3, "z", 1), (4, "n", 1)], "id int, v string, emb int")
    assert {r["id"]: r["op"] for r in cdc.diff(a, b, ["id"], ["emb"]).collect()} == {1: "same", 2: "delete", 3: "update", 4: "insert"}
    assert cdc.pending(spark.range(10_001)) == cdc.PENDING_MANY and cdc.pending(spark.range(10_001), True) == 10_001


def test_stream_is_idempotent(spark, folder):
    schema = "id int, body string, note string, op string, version long"
    spark.createDataFrame([(1, "first post", "n", "insert", 1), (1, "second post", "n", "update", 2), (2, "other", "n", "insert", 1)], schema).coalesce(1).write.parquet(f"{folder}/log")
    p = make(spark, f"{folder}/p", blog(spark, [(1, "x", "n")]))

    def go():
        s = spark.readStream.schema(schema).parquet(f"{folder}/log")
        q = worker.start(p, s, f"{folder}/check", once=True)
        q.awaitTermination()
        return shown(p.table("store").read())

    first = go()
    assert {(r[0], r[2]) for r in first} == {(1, "second"), (1, "post"), (2, "other")} and go() == first
    spark.createDataFrame([(2, None, None, "delete", 2)], schema).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    assert {r[0] for r in go()} == {1}


@pytest.fixture
def model():
    """A model server that refuses requests with ``bad`` in a text; its address, what it was sent, and a switch."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    sent, mended = [], threading.Event()

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            sent.append(texts)
            bad = not mended.is_set() and any("bad" in t for t in texts)
            body = b"{}" if bad else json.dumps({"data": [{"index": k, "embedding": [float(len(t)), 1.0]} for k, t in enumerate(texts)]}).encode()
            self.send_response(400 if bad else 200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", sent, mended
    server.shutdown()


def refusing(df, url):
    embedding = C.embedding_openai("none-such", 2) | {"base_url": url, "api_key": "k"}
    return C.vectorizer("default.blog", df.schema, ["id"], C.loading_column("body"), embedding, chunking=C.chunking_none(), formatting=C.formatting_python_template("$chunk"), processing=C.processing_default(batch_size=2))


def test_a_failed_request_costs_its_own_batch(spark, folder, model):
    url, sent, mended = model
    df = blog(spark, [(k, f"{'bad' if k == 5 else 'good'} text {k}", "n") for k in range(8)]).coalesce(1)
    p = Pipeline(spark, refusing(df, url), folder)
    done = p.run(df)
    assert done["insert"] == 8 and done["failed"] == 2 and [len(t) for t in sent] == [2] * 4
    assert sorted(r["id"] for r in p.table("store").read().collect()) == [0, 1, 2, 3, 6, 7]
    e = p.table("errors").read().collect()
    assert [(r["message"], "400" in r["details"], '"chunks":2' in r["details"]) for r in e] == [("embedding provider failed", True, True)]
    last = p.table("progress").read().first()
    assert (last["success_count"], last["error_count"], last["last_error"]) == (6, 2, "embedding provider failed")
    assert p.status().first()["pending_items"] == 2
    mended.set()
    done = p.run(df)  # what failed is sent again, and nothing else
    assert sent[4:] == [["good text 4", "bad text 5"]] and done["retried"] == 2 and done["failed"] == 0
    assert p.table("store").read().count() == 8 and p.table("queue").read().count() == 0
    mended.clear()
    p.run(blog(spark, [(1, "bad news", "n")]))  # the old chunk stays until the new one is embedded; the others are gone
    assert [(r["id"], r["chunk"]) for r in p.table("store").read().collect()] == [(1, "good text 1")]


def test_a_stream_keeps_what_was_refused(spark, folder, model):
    url, sent, mended = model
    df = blog(spark, [(1, "x", "n")])
    p = Pipeline(spark, refusing(df, url), folder)
    schema = "id int, body string, note string, op string, version long"
    batch = lambda rows, n: worker.apply_changes(p, spark.createDataFrame(rows, schema).coalesce(1), n)
    chunks = lambda: sorted((r["id"], r["chunk"]) for r in p.table("store").read().collect())
    batch([(1, "good one", "n", "insert", 1), (2, "also good", "n", "insert", 1), (3, "bad three", "n", "insert", 1), (4, "bad four", "n", "insert", 1)], 0)
    assert chunks() == [(1, "good one"), (2, "also good")] and p.status().first()["pending_items"] == 2
    again = len(sent)
    batch([(1, "good one", "n", "insert", 1), (2, "also good", "n", "insert", 1), (3, "bad three", "n", "insert", 1), (4, "bad four", "n", "insert", 1)], 0)
    assert len(sent) == again and p.table("errors").read().count() == 1 and p.table("progress").read().count() == 1  # the same batch again
    mended.set()
    batch([(4, None, None, "delete", 2), (5, "five", "n", "insert", 1)], 1)
    assert chunks() == [(1, "good one"), (2, "also good"), (3, "bad three"), (5, "five")] and p.status().first()["pending_items"] == 0


def test_requests_fail_in_arrow_batches(spark):
    from embedlake.functions import models

    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    bad = {"implementation": "openai", "model": "m", "base_url": "http://127.0.0.1:9", "retry_seconds": 0.0}
    got = {r["id"]: r["x"] for r in df.select("id", models.try_embed("t", bad).alias("x")).collect()}
    assert got[1]["value"] is None and "refused" in got[1]["error"] and got[2]["error"] is None
    good = {r["id"]: r["x"] for r in df.select("id", models.try_embed("t", {"implementation": "hash", "dimensions": 3}).alias("x")).collect()}
    assert len(good[1]["value"]) == 3 and good[1]["error"] is None and good[2]["value"] is None


def test_counts_say_what_failed_to_load(spark, folder, tmp_path):
    (tmp_path / "there.txt").write_text("here it is")
    df = spark.createDataFrame([(1, str(tmp_path / "there.txt")), (2, str(tmp_path / "none.txt"))], "id int, url string")
    p = make(spark, folder, df, loading=C.loading_uri("url", retries=2))
    assert p.run(df)["not_loaded"] == 1
    last = p.table("progress").read().first()
    assert (last["success_count"], last["error_count"]) == (1, 1) and {r["id"] for r in p.table("store").read().collect()} == {1}


def test_stream_retries_what_does_not_load(spark, folder, tmp_path):
    """A missing file waits in the query's state; it is opened again by a timer, and given up after its retries."""
    import time

    (tmp_path / "there.txt").write_text("here it is")
    schema = "id int, url string, op string, version long"
    rows = [(1, str(tmp_path / "there.txt"), "insert", 1), (2, str(tmp_path / "late.txt"), "insert", 1), (3, str(tmp_path / "never.txt"), "insert", 1), (4, str(tmp_path / "never.txt"), "insert", 1)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/log")
    df = spark.createDataFrame([(1, "x")], "id int, url string")
    p = make(spark, f"{folder}/p", df, loading=C.loading_uri("url", retries=2))
    q = worker.start(p, spark.readStream.schema(schema).parquet(f"{folder}/log"), f"{folder}/check", poll="1 second", retry_minutes=0.05)

    def until(what, most=90):
        end = time.time() + most
        while time.time() < end:
            assert q.isActive, q.exception()
            try:
                if what():
                    return
            except Exception as e:  # a table that was replaced twice while it was read
                if "FILE_NOT_EXIST" not in str(e) and "PATH_NOT_FOUND" not in str(e):
                    raise
            time.sleep(0.5)
        raise AssertionError("not in time")

    table = lambda name: p.table(name).read() if p.table(name).exists() else spark.range(0).withColumn("error_count", F.lit(0))
    ids = lambda name: sorted({r["id"] for r in table(name).collect()})
    try:
        until(lambda: p.table("progress").exists())
        first = p.table("progress").read().orderBy("at").first()
        assert (first["success_count"], first["error_count"]) == (1, 3) and ids("store") == [1]
        assert set(ids("queue")) <= {2, 3, 4} and "is_retryable" in table("errors").first()["details"]
        (tmp_path / "late.txt").write_text("here too")
        spark.createDataFrame([(4, None, "delete", 2)], schema).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        until(lambda: ids("store") == [1, 2] and ids("dead") == [3] and ids("queue") == [])
        tried = lambda: [r["details"] for r in table("errors").where("details like '%\"id\":3%'").collect()]
        until(lambda: len(tried()) == 3)
        reasons = tried()
        assert sum('"is_retryable":false' in r for r in reasons) == 1
        # a stop marker ends the query behind a batch; heartbeats and progress are on record
        worker.request_stop(p)
        assert worker.watch(p, q, 0.5, 60) and not q.isActive and not worker.stop_requested(p)
        events = [r["event"] for r in p.table("workers").read().orderBy("at").collect()]
        assert events[0] == "started" and events[-1] == "stopped"
    finally:
        q.stop()


def test_dataset(spark, folder):
    assert dataset.table_name("hub/Rotten-Tomatoes", "v1") == "rotten_tomatoes_v1"
    long = dataset.table_name("a_" + "b" * 40 + "_" + "c" * 40)
    assert long == "a_" + "b" * 40
    spark.createDataFrame([(1, (2, "x"))], "a int, s struct<b: int, c: string>").write.parquet(f"{folder}/d")
    assert dataset.load_dataset(spark, f"{folder}/d", table="loaded", if_table_exists="drop", field_types={"a": "smallint"}) == 1
    assert spark.table("loaded").dtypes == [("a", "smallint"), ("s_b", "int"), ("s_c", "string")]
    assert dataset.load_dataset(spark, f"{folder}/d", table="loaded", if_table_exists="append", field_types={"a": "smallint"}) == 1
    spark.dataSource.register(dataset.generator_source("numbers", "n int", lambda split: iter([(k,) for k in range(5)]), ["train", "test"]))
    assert spark.read.format("numbers").load().count() == 10 and spark.read.format("numbers").option("split", "test").load().count() == 5
