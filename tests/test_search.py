"""Words, samples, keys and access."""

import math
import re

import pytest
from pyspark.sql import functions as F

from embedlake import config as C
from embedlake.operators import sampling, words
from embedlake.operators.words import WordIndex, fused
from embedlake.semantic import describe, keys
from embedlake.semantic.catalog import Catalog


def test_words(spark, folder):
    texts = [(1, "Red apples, red wine"), (2, "green apples"), (3, None), (4, "Äpfel und Wein"), (5, "red " * 50), (6, ""), (7, "wine")]
    ix = WordIndex(spark, folder)
    assert ix.build(spark.createDataFrame(texts, "i int, t string").repartition(3), "i", "t") == {"texts": 7, "words": 60}
    got = [(r["id"], r["score"]) for r in ix.search("RED wine!", 10).collect()]
    own, want = {i: re.findall(r"\w+", (t or "").lower()) for i, t in texts}, []
    for i, w in own.items():
        score = 0.0
        for q in ("red", "wine"):
            df, tf = sum(q in x for x in own.values()), w.count(q)
            score += math.log(1 + (7 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / (60 / 7)))
        want += [(i, round(score, 6))] * (score > 0)
    assert got == sorted(want, key=lambda x: (-x[1], x[0])) and len(got) == 3
    assert [r["id"] for r in ix.search("äpfel", 10).collect()] == [4] and ix.search("none such", 10).count() == 0 and ix.search(" ,", 10).count() == 0
    some = spark.createDataFrame([(5,), (2,)], "x int")
    only = [(r["id"], r["score"]) for r in ix.search("red wine", 10, only=some).collect()]
    assert only == [x for x in got if x[0] == 5]  # figures are those of all texts
    ix.build(spark.createDataFrame([(9, "red")], "i int, t string"), "i", "t")
    assert [r["id"] for r in ix.search("red", 10).collect()] == [9]
    a, b = (spark.createDataFrame(list(zip(x, range(9))), "id int, _by int") for x in ([1, 2, 3], [3, 9]))
    assert [r["id"] for r in fused([a, b], "id", 3).collect()] == [3, 1, 2]


def test_postings_are_counted_without_a_shuffle(spark, folder, monkeypatch):
    texts = [(1, ["b", "a", "b"]), (2, []), (3, ["a"]), (4, ["ä", "b"]), (5, [])]
    df = spark.createDataFrame(texts, "id long, _w array<string>").coalesce(1)
    assert "Exchange" not in words.postings(df)._jdf.queryExecution().executedPlan().toString()
    for work, most in ((1 << 20, 3), (1, 6)):  # a row a term, or one for each text
        monkeypatch.setattr(words, "WORK", work)
        rows = words.postings(df).collect()
        got = sorted((r["term"], *x) for r in rows for x in zip(r["ids"], r["tfs"], r["lens"], strict=True))
        assert got == [("a", 1, 1, 3), ("a", 3, 1, 1), ("b", 1, 2, 3), ("b", 4, 1, 2), ("ä", 4, 1, 2)]
        assert len(rows) <= most and sum(r["words"] for r in rows) == 6
    ix = WordIndex(spark, folder)
    ix.build(spark.createDataFrame([(1, "red wine"), (1, "red beer"), (2, "ale")], "i int, t string").repartition(3), "i", "t")
    twice = ix.search("red", 5).collect()
    assert len(twice) == 1 and twice[0]["score"] > 0


def test_samples_merge_and_dont_depend_on_partitions(spark):
    df = spark.range(2000).withColumn("g", F.col("id") % 3)
    one = [r["id"] for r in sampling.sample(df.repartition(7), 50, ["id"], 4).collect()]
    assert one == [r["id"] for r in sampling.sample(df.coalesce(1), 50, ["id"], 4).collect()] and one != sorted(one)
    parts = sampling.sample(df.where("id < 700"), 50, ["id"], 4).unionByName(sampling.sample(df.where("id >= 700"), 50, ["id"], 4))
    assert one == [r["id"] for r in sampling.sample(parts, 50, ["id"], 4).collect()]
    assert one != [r["id"] for r in sampling.sample(df, 50, ["id"], 5).collect()]
    assert {r["g"]: r["count"] for r in sampling.sample_by(df, 5, ["g"], ["id"]).groupBy("g").count().collect()} == {0: 5, 1: 5, 2: 5}


def test_keys(spark):
    a = spark.createDataFrame([(k, f"n{k}", k % 7, None if k == 3 else k) for k in range(300)], "a_key int, a_name string, a_small int, a_null int")
    b = spark.createDataFrame([(k, k % 250 if k else None, 400 if k == 7 else k % 250) for k in range(500)], "b_id int, b_key int, b_off int")
    assert keys.unique_columns(keys.profile(a)) == ["a_key", "a_name"] and keys.unique_columns(keys.profile(b)) == ["b_id"]
    found = keys.references({"a": a, "b": b})
    assert ("b", "b_key", "a", "a_key") in found and ("b", "b_off", "a", "a_key") not in found and ("a", "a_small", "b", "b_id") in found
    assert keys.constraints({"a": a, "b": b})["b"] == ["UNIQUE (b_id)", "FOREIGN KEY (b_key) REFERENCES a (a_key)"]
    assert keys.unique_columns(keys.profile(a.where("false"))) == []


def test_loaded_relations_have_their_keys(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS found")
    spark.createDataFrame([(k, f"n{k}") for k in range(20)], "t_key int, t_name string").write.mode("overwrite").saveAsTable("found.one")
    spark.createDataFrame([(k, k % 20, k % 4) for k in range(60)], "u_id int, u_key int, u_n int").write.mode("overwrite").saveAsTable("found.two")
    two = describe.load_all(spark, ["found.one", "found.two"])[1]
    assert two.constraints == [("two_key1", "UNIQUE (u_id)"), ("two_fk2", "FOREIGN KEY (u_key) REFERENCES found.one (t_key)")]
    assert "ADD CONSTRAINT two_fk2 FOREIGN KEY (u_key)" in describe.render_relation(two)


def test_access_is_decided_before_the_limit(spark, folder):
    c = Catalog(spark, folder)
    c.add_embedding(C.embedding_hash(4))
    rows = [("table", "s", f"t{k:02d}", None, [], f"about {'open' if k % 4 == 0 else 'closed'} {k}") for k in range(24)]
    c.set_descriptions(spark.createDataFrame(rows, "objtype string, schema_name string, name string, column_name string, args array<string>, description string"))
    assert [r["id"] for r in c.list("objects").collect()] == list(range(1, 25))
    c.vectorize("emb1")
    allowed = F.col("description").startswith("about open")
    assert c.search_owners("emb1", "anything", 5, allowed=allowed).count() == 5 and c.search("objects", "emb1", "anything", 50, allowed=allowed).count() == 6
    c.index_words("objects")
    got = c.search_ranked("objects", "emb1", "open 8", 4, allowed=allowed).collect()
    assert "t08" in {r["name"] for r in got} and len(got) == 4 and all("open" in r["description"] for r in got)
    with pytest.raises(ValueError, match="unknown object type"):
        c.set_description("nothing", "s", "n", "d")
