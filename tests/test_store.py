"""Upserts of tables in buckets, and texts that are embedded in pieces."""

import pyarrow as pa

from embedlake.functions import models
from embedlake.plans import store
from embedlake.semantic import keys


def test_upsert_lays_new_rows_beside_old_ones(spark, folder, monkeypatch):
    for name, few in (("a", 1_000_000), ("b", 0)):  # by broadcast, and by a shuffle
        monkeypatch.setattr(store, "FEW", few)
        t, want = store.Table(spark, f"{folder}/{name}", 4), {k: "old" for k in range(60)}
        t.write(spark.createDataFrame(list(want.items()), "k int, v string"), keys=["k"])
        for step in range(3):
            new = {k: f"new{step}" for k in range(step, 60, 7)}
            gone = list(range(step, 60, 11))
            want = {k: v for k, v in want.items() if k not in gone} | new
            t.upsert(spark.createDataFrame(list(new.items()), "k int, v string"), ["k"], spark.createDataFrame([(k,) for k in gone], "k int"))
            assert {r["k"]: r["v"] for r in t.read().collect()} == want and t.read().count() == len(want)
            parts = t._pointer()["parts"]
            beside = spark.read.parquet(*[f"{t.path}/{f}" for b, f in parts.items() if b.endswith("+")])
            assert {r["v"] for r in beside.collect()} == {f"new{step}"}  # written once, not again with the old ones


def test_texts_are_held_in_pieces(spark, monkeypatch):
    texts = ["a" * 6, None, "b" * 6, "c" * 30, "", "ä"]
    monkeypatch.setattr(models, "HELD", 12)
    got = list(models._pieces(pa.array(texts), 4))
    assert [len(p) for p in got] == [3, 1, 2] and [t for p in got for t in p] == texts
    assert [len(p) for p in models._pieces(pa.array(texts), 1)] == [1] * 6
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1)
    config = {"implementation": "hash", "dimensions": 3}
    rows = df.select("k", "t", models.embed("t", config).alias("a"), models.try_embed("t", config).alias("b")).collect()
    assert all(r["a"] == (r["b"] or {"value": None})["value"] and (r["a"] is None) == (r["t"] is None) for r in rows)


def test_tables_are_profiled_once(spark, monkeypatch):
    a = spark.createDataFrame([(k, k % 7) for k in range(50)], "a_key int, a_small int")
    b = spark.createDataFrame([(k, k % 50) for k in range(90)], "b_id int, b_key int")
    own, seen = keys.profile, []
    monkeypatch.setattr(keys, "profile", lambda df: seen.append(df) or own(df))
    assert keys.constraints({"a": a, "b": b}) == {"a": ["UNIQUE (a_key)"], "b": ["UNIQUE (b_id)", "FOREIGN KEY (b_key) REFERENCES a (a_key)"]} and len(seen) == 2
