"""The graph index and bit codes against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedlake import config as C
from embedlake.catalogue import QUERIES
from embedlake.operators import ann, codes, ivf, knn
from embedlake.plans.pipeline import Pipeline

D = "/root/testdata/{}"


def table(spark, sf):
    return spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")


def exact(rows, asked, k=10):
    found = knn.batch_top_k(rows, asked.withColumnRenamed("vec_id", "query_id"), k, "vec_id", "query_id").collect()
    return {(r["query_id"], r["vec_id"]) for r in found}


def recall(found, want, query="query_id"):
    return len({(r[query], r["vec_id"]) for r in found} & want) / len(want)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_search(spark, sf):
    e = table(spark, sf)
    want = exact(e, e.where("vec_id % 20 = 0"))
    got = QUERIES["vec_graph_search"](spark, D.format(sf)).collect()
    assert len(got) == len(want) and recall(got, want, "query_vec_id") >= 0.9


def test_registered_changes(spark):
    e = table(spark, "sf0.1")
    now = e.where("vec_id % 11 <> 2 or vec_id % 7 = 1").withColumn("embedding", ann.F.when(ann.F.col("vec_id") % 7 == 1, ann.F.reverse("embedding")).otherwise(ann.F.col("embedding")))
    got = QUERIES["vec_graph_changes"](spark, D.format("sf0.1")).collect()
    want = exact(now, e.where("vec_id % 20 = 0"))
    assert recall(got, want, "query_vec_id") >= 0.9 and not [r for r in got if r["vec_id"] % 11 == 2 and r["vec_id"] % 7 != 1]


def test_walks_compare_less_than_scans():
    rng = np.random.default_rng(3)
    center = rng.normal(size=(40, 24))
    x = (center[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 24)) * 0.5).astype("f4")
    q = x[::40].astype(float) + rng.normal(size=(100, 24)) * 0.1
    want = np.argsort(((q[:, None] - x[None]) ** 2).sum(axis=2), axis=1)[:, :10]
    found = {}
    for name, o in {
        "all": ann.Options(storage_layout="plain"), "short": ann.Options(storage_layout="plain", search_list_size=12), "few": ann.Options(storage_layout="plain", num_neighbors=6, search_list_size=30),
        "strict": ann.Options(storage_layout="plain", num_neighbors=50, max_alpha=1.0, search_list_size=30), "loose": ann.Options(storage_layout="plain", num_neighbors=50, max_alpha=1.5, search_list_size=30),
        "codes": ann.Options(), "one bit": ann.Options(num_bits_per_dimension=1), "four bits": ann.Options(num_bits_per_dimension=4),
    }.items():
        cuts = ann.thresholds(x.astype(float), o.bits(24)) if o.storage_layout == "memory_optimized" else None
        leaf = ann.Leaf.build(x, o, cuts, "vector_l2_ops")
        ids, d, compared = leaf.search(q, "vector_l2_ops", o, cuts)
        order = [int(np.flatnonzero((leaf.vectors == v).all(axis=1))[0]) for v in x]
        hit = np.mean([len({order[j] for j in w} & set(i[:10].tolist())) / 10 for w, i in zip(want, ids, strict=True)])
        assert (np.diff(d, axis=1) >= 0).all()
        found[name] = (hit, compared / len(q), (leaf.graph >= 0).sum(axis=1).mean())
    print(found)
    assert found["all"][0] >= 0.95 and found["all"][1] < 0.4 * len(x)
    assert found["short"][1] < 0.6 * found["all"][1] and found["short"][0] <= found["all"][0]
    assert found["few"][2] <= 6 < found["all"][2] and found["strict"][2] < found["loose"][2]
    assert found["four bits"][0] > found["one bit"][0] and found["codes"][0] >= 0.8


def test_small_leaves_are_compared_whole():
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(600, 24)).astype("f4"), rng.normal(size=(30, 24))
    for metric in ("vector_cosine_ops", "vector_l2_ops", "vector_ip_ops", "vector_l1_ops"):
        o = ann.Options()
        leaf = ann.Leaf.build(x, o, ann.thresholds(x.astype(float), 2), metric)
        ids, d, compared = leaf.search(q, metric, o, ann.thresholds(x.astype(float), 2))
        want = np.sort(knn._distances(q, leaf.vectors.astype(float), metric), axis=1)[:, :100]
        assert compared == 30 * 600 and np.allclose(d, want) and all(len(set(i)) == 100 for i in ids.tolist())


def test_cells_are_assigned_in_small_pieces():
    import tracemalloc

    rng = np.random.default_rng(6)
    x, c = rng.normal(size=(10_000, 16)), rng.normal(size=(600, 16))
    tracemalloc.start()
    at = ivf._assign(x, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20 and (at[::500] == ((x[::500, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_queries_of_a_cell_share_blocks(spark):
    asks = spark.range(3000).select(F.col("id").alias("_q"), F.array(F.lit(1.0)).alias("_v"), F.when(F.col("id") < 1200, 99).otherwise(F.col("id") % 30).cast("int").alias("cell"))
    got = [(r["cell"], r["n"]) for r in ann.Index._blocks(asks).select("cell", F.size("_asks").alias("n")).collect()]
    assert sum(n for _, n in got) == 3000 and sum(c != 99 for c, _ in got) == 30 and sum(c == 99 for c, _ in got) == 3


def test_build_holds_all_keys_and_copies(spark, folder):
    rows = [(k, f"g{k % 3}", [float(k % 5), 1.0, float(k % 7)]) for k in range(300)] + [(500, "x", None), (501, "x", [1.0]), (502, "x", [float("nan"), 0.0, 0.0]), (503, "x", [None, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "a int, b string, v array<double>").repartition(3)
    ix = ann.Index(spark, folder, ["a", "b"], "v")
    assert not ix.exists()
    meta = ix.build(df, "vector_l2_ops", cells=3)
    assert meta["rows"] == 300 and sorted((r["a"], r["b"], tuple(r["v"])) for r in ix.rows().collect()) == sorted((a, b, tuple(v)) for a, b, v in rows[:300])
    got = ix.search([0.0, 1.0, 0.0], 12, probes=3).collect()
    assert {(r["a"], r["distance"]) for r in got[:9]} == {(k, 0.0) for k in range(0, 300, 35)} and [r["rank"] for r in got] == list(range(1, 13))


@pytest.mark.parametrize("metric", ["vector_cosine_ops", "vector_l2_ops", "vector_ip_ops", "vector_l1_ops"])
def test_segments_and_compaction(spark, folder, metric):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8)).astype("f4")
    rows = lambda ids, at: spark.createDataFrame([(int(i), [float(v) for v in at[i]]) for i in ids], "vec_id long, embedding array<float>")
    ix = ann.Index(spark, folder, ["vec_id"])
    ix.build(rows(range(400), x), metric, ann.Options(storage_layout="plain"), cells=4)
    y = x.copy()
    y[:30] = rng.normal(size=(30, 8))
    assert ix.upsert(rows(range(20), y)) == 1 and ix.upsert(rows(range(20, 30), y), rows(range(100, 150), x).select("vec_id")) == 2
    live = [i for i in range(400) if not 100 <= i < 150]
    asked = rows(range(0, 400, 20), y)
    for _ in range(2):
        assert sorted(r["vec_id"] for r in ix.rows().collect()) == live
        for many in (32 << 20, 0):  # by broadcast, and by a shuffle
            got = ix.search_many(asked, 5, "vec_id", probes=100, query_bytes=many).collect()
            want = {(int(i), live[j]) for i in range(0, 400, 20) for j in np.argsort(knn._distances(y[i : i + 1].astype(float), y[live].astype(float), metric)[0], kind="stable")[:5]}
            assert recall(got, want) >= 0.98
        assert ix.stale() is (_ == 0)
        before = set(ix.table._pointer()["parts"])
        ix.compact()
        assert not before & set(ix.table._pointer()["parts"])


def test_cells_join_queries_without_the_driver(spark, folder):
    e = table(spark, "sf0.01")
    ivf.build(e, folder)
    rows = lambda n: sorted((r["query_id"], r["vec_id"], r["rank"], round(r["distance"], 9) + 0.0) for r in ivf.search_many(spark, folder, e.where("vec_id % 20 = 0"), 5, "vec_id", "vec_id", query_bytes=n).collect())
    assert rows(32 << 20) == rows(3000) and len(rows(3000)) == 125


def test_codes(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 70))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [1.0])], "id long, v array<double>")
    for bits in (1, 3):
        cuts = codes.thresholds(df.where("size(v) = 70"), "v", bits)
        coded = df.withColumn("code", codes.code("v", cuts))
        got = {r["id"]: r["code"] for r in coded.collect()}
        assert got[900] is None and got[901] is None and all(got[i] == codes.code_of(x[i], cuts) for i in range(300))
        q = codes.code_of(x[7], cuts)
        bit = {r["id"]: r["h"] for r in coded.where("code is not null").select("id", codes.hamming("code", q).alias("h")).collect()}
        levels = (x[:, :, None] > np.array(cuts)[None]).reshape(300, -1)
        assert [bit[i] for i in range(300)] == (levels != levels[7]).sum(axis=1).tolist()
        assert [r["id"] for r in codes.search(coded, x[7], cuts, 3, ["id"], "v", metric="vector_l2_ops", candidates=300).collect()] == np.argsort(((x - x[7]) ** 2).sum(axis=1))[:3].tolist()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_codes(spark, sf):
    e = table(spark, sf)
    cuts = codes.thresholds(e, bits=2)
    coded = e.withColumn("code", codes.code("embedding", cuts)).cache()
    hit, n = 0, 0
    for r in e.where("vec_id % 200 = 0").collect():
        best = {x["vec_id"] for x in knn.top_k(e, r["embedding"], 10, ["vec_id"]).collect()}
        hit += len(best & {x["vec_id"] for x in codes.search(coded, r["embedding"], cuts, 10, ["vec_id"]).collect()})
        n += len(best)
    assert hit >= 0.9 * n


def test_pipeline_builds_its_index(spark, folder):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(60)], "id long, body string")
    for i, (made, o) in enumerate([(C.indexing_diskann(min_rows=50, num_neighbors=7, search_list_size=9, max_alpha=1.5, num_bits_per_dimension=3), (7, 9, 1.5, 3, "memory_optimized")), (C.indexing_hnsw(min_rows=50, m=4, ef_construction=20), (8, 100, 1.0, 0, "plain"))]):
        c = C.vectorizer("default.t", docs.schema, ["id"], C.loading_column("body"), C.embedding_hash(8), chunking=C.chunking_none(), formatting=C.formatting_python_template("$chunk"), indexing=made, scheduling=C.scheduling_periodic())
        p = Pipeline(spark, c, f"{folder}/p{i}")
        assert not p.maybe_index(f"{folder}/ix{i}")
        p.run(docs)
        assert p.maybe_index(f"{folder}/ix{i}") and not p.maybe_index(f"{folder}/ix{i}")
        ix = ann.Index(spark, f"{folder}/ix{i}", ["id", "chunk_seq"])
        x = ix.meta()["options"]
        assert (x["num_neighbors"], x["search_list_size"], x["max_alpha"], x["num_bits_per_dimension"], x["storage_layout"]) == o
        v = p.table("store").read().where("id = 5").first()["embedding"]
        assert ix.search(v, 1).first()["id"] == 5
