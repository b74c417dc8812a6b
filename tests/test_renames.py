import pytest
from pyspark.sql import functions as F

from embedlake.config import embedding_hash
from embedlake.semantic import renames
from embedlake.semantic.catalog import Catalog


def people(spark, n=60, a=0):
    return spark.range(a, a + n).select(
        F.col("id").alias("person_id"), F.concat(F.lit("name "), "id").alias("full_name"), F.concat(F.lit("street "), (F.col("id") * 7).cast("string")).alias("street"),
        (F.col("id") % 2 == 0).alias("active"), (F.col("id") % 2 == 0).alias("paid"), F.create_map(F.lit("k"), "id").alias("more"), F.lit(None).cast("double").alias("blank"),
    )


def told(df):
    return sorted(map(tuple, df.collect()))


def test_relations(spark):
    other = spark.range(40).select((F.col("id") + 1000).alias("order_id"), F.col("id").alias("person_id"))
    old = renames.snapshot(spark, {"a.people": people(spark), "a.orders": other, "a.gone": spark.range(5).select(F.col("id").cast("string").alias("z"))})
    new = renames.snapshot(spark, {"b.humans": people(spark, 62).withColumnRenamed("street", "road"), "a.sales": other})
    assert told(renames.relations(old, new)) == [("rename", "a.orders", "a.sales"), ("rename", "a.people", "b.humans")]
    assert told(renames.relations(new, new.limit(0))) == [] and told(renames.relations(old.limit(0), new)) == []
    # two copies: neither is the one; two tables of the same columns are told apart by their rows
    copies = renames.snapshot(spark, {"a.c1": other, "a.c2": other})
    assert told(renames.relations(old.where("name = 'orders'"), copies)) == [("ambiguous", "a.orders", None)]
    years = renames.snapshot(spark, {"a.y1": people(spark), "a.y2": people(spark, 60, 1000)})
    moved = renames.snapshot(spark, {"a.z2": people(spark, 60, 1000), "a.z1": people(spark)})
    assert told(renames.relations(years, moved)) == [("rename", "a.y1", "a.z1"), ("rename", "a.y2", "a.z2")]


def test_columns(spark):
    before = renames.snapshot(spark, {"a.people": people(spark), "a.none": people(spark).limit(0)})
    names = {"full_name": "label", "street": "road", "active": "f1", "paid": "f2", "more": "rest", "blank": "empty"}
    now = people(spark, 64).withColumnsRenamed(names).select("road", "label", "person_id", "f1", "f2", "rest", "empty")
    after = renames.snapshot(spark, {"a.people": now, "a.none": people(spark).limit(0).withColumnRenamed("street", "road")})
    pairs = spark.createDataFrame([("a.people", "a.people"), ("a.none", "a.none")], "old string, new string")
    found = told(renames.columns(before, after, pairs))
    assert ("a.people", "rename", "full_name", "label") in found and ("a.people", "rename", "street", "road") in found and ("a.people", "rename", "more", "rest") in found
    assert ("a.people", "ambiguous", "active", None) in found and ("a.people", "ambiguous", "paid", None) in found  # the same values in both
    assert ("a.people", "rename", "blank", "empty") in found and [r for r in found if r[0] == "a.none"] == [("a.none", "rename", "street", "road")]  # without values by place and type
    assert not any("person_id" in r for r in found)


@pytest.fixture
def lake(spark, folder):
    spark.sql("CREATE DATABASE IF NOT EXISTS moving")
    for t in spark.catalog.listTables("moving"):
        spark.sql(f"DROP TABLE moving.{t.name}")
    people(spark).drop("more").write.saveAsTable("moving.people")
    spark.range(9).write.saveAsTable("moving.lost")
    c = Catalog(spark, folder)
    c.add_embedding(embedding_hash(8))
    for name, column, text in (("people", None, "persons"), ("people", "street", "where they live"), ("people", "full_name", "what they are called"), ("lost", None, "numbers")):
        c.set_description("column" if column else "table", "moving", name, text, column)
    c.add_fact("people move")
    c.vectorize("emb1")
    c.remember()
    return c


def about(c):
    return {(r["name"], r["column_name"]): (r["id"], r["description"], r["emb1"] is not None) for r in c.rows("objects").collect()}


def test_refresh_keeps_descriptions(spark, lake):
    assert lake.refresh() == []
    spark.table("moving.people").withColumnRenamed("street", "road").write.saveAsTable("moving.humans")
    spark.sql("DROP TABLE moving.people")
    spark.sql("DROP TABLE moving.lost")
    before = about(lake)
    said = [("rename", "moving.people -> moving.humans"), ("rename", "moving.humans.street -> road"), ("delete", "moving.lost")]
    assert lake.refresh(dry_run=True) == said and about(lake) == before
    assert lake.refresh() == said and lake.refresh() == []
    now = about(lake)
    assert {k: v[1] for k, v in now.items()} == {("humans", None): "persons", ("humans", "road"): "where they live", ("humans", "full_name"): "what they are called"}
    assert now["humans", "road"][0] == before["people", "street"][0] and not any(v[2] for v in now.values())
    assert lake.vectorize("emb1") == 3
    # a column of a relation that stays; then two copies of it
    spark.table("moving.humans").withColumnRenamed("full_name", "label").write.saveAsTable("moving.tmp")
    spark.sql("DROP TABLE moving.humans")
    spark.sql("ALTER TABLE moving.tmp RENAME TO moving.humans")
    assert lake.refresh() == [("rename", "moving.humans.full_name -> label")] and about(lake)["humans", "label"][1] == "what they are called"
    assert about(lake)["humans", "road"][2] and not about(lake)["humans", "label"][2]
    for k in (1, 2):
        spark.table("moving.humans").write.saveAsTable(f"moving.copy{k}")
    spark.sql("DROP TABLE moving.humans")
    assert lake.refresh() == [("ambiguous", "moving.humans")] and len(about(lake)) == 3
    spark.sql("DROP TABLE moving.copy2")
    assert lake.refresh() == [("rename", "moving.humans -> moving.copy1")]
