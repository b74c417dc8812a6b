import math

import pytest

from embedlake.functions import models, providers, template
from embedlake.functions import vector as V
from embedlake.operators import ivf, knn
from embedlake.operators.batching import BatchingError, batch_indices, estimated_tokens
from embedlake.session import register_all
from embedlake.sources import loading

T = [5, 1, 1, 1, 1, 1, 1, 1, 1]
S = [1, 8, 2, 5, 9, 5, 6, 11]


@pytest.mark.parametrize(
    ("lengths", "chunks", "tokens", "want"),
    [
        ([], 1, None, []), (T, 1, None, [(k, k + 1) for k in range(9)]), (T, 3, None, [(0, 3), (3, 6), (6, 9)]), (T, 5, None, [(0, 5), (5, 9)]),
        (T, 5, 6, [(0, 2), (2, 7), (7, 9)]), (S, 5, 20, [(0, 4), (4, 7), (7, 8)]),
    ],
)
def test_batch_indices(lengths, chunks, tokens, want):
    assert batch_indices(lengths, chunks, tokens) == want


def test_batch_errors_and_estimates():
    with pytest.raises(BatchingError, match="chunk length 5 greater than max_tokens_per_batch 2"):
        batch_indices(T, 5, 2)
    for text, n, want in (("ф" * 300, 1001, 1), ("中" * 1000, 500, 2), ("apple " * 1000, 299, 2), ("a", 800, 1)):
        assert len(batch_indices([estimated_tokens(text)] * n, 2048, 300_000)) == want


def test_limits():
    assert providers.limits({"implementation": "litellm", "model": "cohere/x"}).chunks == 96
    assert providers.limits({"implementation": "litellm", "model": "odd/x"}) == providers.UNKNOWN
    assert providers.limits({"implementation": "voyageai", "model": "voyage-2"}).tokens == 320_000
    with pytest.raises(ValueError, match="1536"):
        providers.provider({"implementation": "openai", "model": "text-embedding-ada-002", "dimensions": 8})
    assert providers.api_key("openai", None, "MINE", {"MINE": "k", "OPENAI_API_KEY": "o"}) == "k"


def test_long_texts_are_cut_for_openai():
    """Requests to a local server: no text is longer than the model takes."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    import public_tokenizers
    import tiktoken

    seen = []

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, asked, self.headers["Authorization"]))
            body = json.dumps({"data": [{"index": k, "embedding": [float(len(t)), 0.0]} for k, t in enumerate(asked["input"])]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
        config = {"implementation": "openai", "model": "none-such", "dimensions": 2, "base_url": f"http://127.0.0.1:{server.server_port}", "api_key": "k"}
        texts = ["short", "many words here " * 9000, "é" * 9000]
        got = providers.embed_batches(providers.provider(config | {"tokenizer": ranks}), texts, providers.Limits(2048))
        own = tiktoken.Encoding("x", pat_str=providers.SPLIT_PATTERN, mergeable_ranks=tiktoken.load.load_tiktoken_bpe(ranks), special_tokens={})
        sent = seen[-1][1]["input"]
        assert len(got) == 3 and seen[-1][0] == "/embeddings" and seen[-1][2] == "Bearer k" and sent[0] == "short"
        assert len(own.encode_ordinary(sent[1])) == providers.OPENAI_CONTEXT and texts[1].startswith(sent[1])
        before = len(seen)
        with pytest.raises(ValueError, match="rank file"):  # nothing is cut in silence
            providers.provider(config).embed(texts)
        providers.provider(config).embed(texts[:1])
        assert len(seen) == before + 1
    finally:
        server.shutdown()


def test_distances(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0])], "id int, e array<double>")
    got = {r["id"]: r for r in df.select("id", V.cosine_distance("e", [1.0, 0.0]).alias("c"), V.l2_distance("e", [0.0, 1.0]).alias("l"), V.l1_distance("e", [0.0, 1.0]).alias("m")).collect()}
    assert got[1]["c"] == 0 and abs(got[2]["c"] - (1 - 1 / math.sqrt(2))) < 1e-12 and got[3]["c"] is None and got[4]["c"] is None and got[5]["c"] is None
    assert got[1]["l"] == math.sqrt(2) and got[1]["m"] == 2
    register_all(spark)
    r = spark.sql("SELECT ai_cosine_distance(array(1D, 0D), array(1D, 1D)) AS c, ai_l2_distance(array(0D, 0D), array(3D, 4D)) AS l, ai_hash_embed('m', 'x', 4) AS e").first()
    assert abs(r["c"] - 0.29289321881) < 1e-9 and r["l"] == 5 and len(r["e"]) == 4
    r = spark.sql("""SELECT * FROM ai_hash_rerank_simple('{"query": "a b", "documents": ["b c", "a b"]}')""").collect()
    assert [(x["index"], x["relevance_score"]) for x in r] == [(1, 1.0), (0, 0.5)]
    assert spark.sql("SELECT * FROM ai_hash_embed_many('m', array('x', 'y'), 3)").count() == 2 and spark.sql("SELECT id FROM ai_hash_models('{}')").first()["id"] == "hash"
    with pytest.raises(Exception, match="expected 3 dimensions"):
        spark.range(1).select(V.vector(V.F.lit("[1,2]"), 3)).collect()


def test_knn_blocks_agree(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(60, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)] + [(100, None, 0)], "id long, e array<float>, label int").repartition(3)
    q = df.where("id % 7 = 0")
    one = knn.batch_top_k(df, q, 4, "id", "id", "e", "e").orderBy("query_id", "rank").collect()
    many = knn.batch_top_k(df, q, 4, "id", "id", "e", "e", query_bytes=200).orderBy("query_id", "rank").collect()
    near = lambda rows: [(r["query_id"], r["id"], r["rank"], round(r["distance"], 9) + 0.0) for r in rows]
    assert near(one) == near(many) and len(one) == 36 and all(r["id"] == r["query_id"] for r in one if r["rank"] == 1)
    same = knn.batch_top_k(df, q, 3, "id", "id", "e", "e", match="label", skip_same=True, metric="vector_l1_ops").collect()
    assert all(r["id"] % 3 == r["query_id"] % 3 and r["id"] != r["query_id"] for r in same)


def test_ivf_recall(spark, folder):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    meta = ivf.build(df, folder, cells=16)
    assert meta["rows"] == 500 and spark.read.parquet(f"{folder}/cells").count() == 500
    hit = 0
    for r in df.where("vec_id % 50 = 0").collect():
        exact = {x["vec_id"] for x in knn.top_k(df, r["embedding"], 10, ["vec_id"]).collect()}
        hit += len(exact & {x["vec_id"] for x in ivf.search(spark, folder, r["embedding"], 10, ["vec_id"], probes=12).collect()})
    assert hit >= 0.9 * 100
    assert ivf.may_build(100_000, 0, False) and not ivf.may_build(99_999, 0, False) and not ivf.may_build(100_000, 1, False) and not ivf.may_build(100_000, 0, True)
    assert ivf.may_build(100_000, 1, False, create_when_queue_empty=False)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_ivf_recall(spark, sf):
    from embedlake.catalogue import QUERIES

    d = f"/root/testdata/{sf}"
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    exact = {(r["query_id"], r["vec_id"]) for r in knn.batch_top_k(e, e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 10, "vec_id", "query_id").collect()}
    got = {(r["query_vec_id"], r["vec_id"]) for r in QUERIES["vec_ivf_search"](spark, d).collect()}
    assert len(got) == len(exact) == 10 * e.where("vec_id % 20 = 0").count()
    print(sf, "recall", len(got & exact) / len(exact))
    assert len(got & exact) >= 0.9 * len(exact)


def test_template(spark):
    df = spark.sql("SELECT 1 AS id, CAST(NULL AS STRING) AS t, true AS b, timestamp'2024-01-06 00:00:00' AS at, 1.5D AS f, 'x' AS chunk")
    assert df.select(template.format_column(df, "$id ${t} $b $at $f $$ $chunk")).first()[0] == "1 None True 2024-01-06 00:00:00+00:00 1.5 $ x"
    with pytest.raises(KeyError):
        template.format_column(df, "$nope $chunk")
    with pytest.raises(ValueError):
        template.format_column(df, "100$ $chunk")


def test_models(spark):
    df = spark.createDataFrame([("I hate it", [("Bob", "PERSON"), ("Bob Smith", "PERSON")]), ("Bob Smith met bob.", [("Bob", "P"), ("Bob Smith", "FULL")])], "t string, e array<struct<name: string, type: string>>")
    status = models.moderation_status(models.call(models.F.to_json(models.F.struct(models.F.col("t").alias("input"))), {"implementation": "hash"}, "moderate"))
    assert [r[0] for r in df.select(status).collect()] == ["flagged", "approved"]
    assert df.select(models.anonymize(df, "t", "e").alias("x")).collect()[1]["x"] == "[FULL] met [P]."
    hits = models.rerank(spark.createDataFrame([("cats",), ("dogs and cats",)], "d string"), "dogs cats", "d", {"implementation": "hash"})
    assert [r["index"] for r in hits.collect()] == [1, 0]
    got = providers.HashProvider().call("classify", {"inputs": ["good food"], "examples": [{"text": "bad", "label": "n"}, {"text": "good", "label": "p"}]})
    assert got["classifications"][0]["prediction"] == "p"


def by_hand(text: str, names: dict[str, str]) -> str:
    """Whole words replaced, found letter by letter; a word's characters are letters, marks, numbers and underscores."""
    import unicodedata

    word = lambda c: c == "_" or unicodedata.category(c)[0] in "LMN"
    for name, kind in names.items():
        out, k = [], 0
        while k < len(text):
            end = k + len(name)
            if text[k:end].lower() == name and not (k and word(text[k - 1])) and not (end < len(text) and word(text[end])):
                out.append(f"[{kind}]")
                k = end
            else:
                out.append(text[k])
                k += 1
        text = "".join(out)
    return text


def test_anonymize_any_script(spark):
    from embedlake.catalogue import QUERIES

    texts = ["the éthe theé thé THE", "ÜBER über überall", "thë the\u0301 the", "中the the中 «the»", None]
    df = spark.createDataFrame([(k, t, [("the", "WORD"), ("über", "PREP")]) for k, t in enumerate(texts)], "id int, t string, e array<struct<name: string, type: string>>")
    got = [r["x"] for r in df.select("id", models.anonymize(df, "t", "e").alias("x")).orderBy("id").collect()]
    assert got == ["[WORD] éthe theé thé [WORD]", "[PREP] [PREP] überall", "thë the\u0301 [WORD]", "中the the中 «[WORD]»", None]
    d = "/root/testdata/sf0.1"
    want = {r["item_id"]: r["text"] and by_hand(r["text"], {"thea": "LONG", "the": "WORD"}) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    assert {r["item_id"]: r["text"] for r in QUERIES["anonymize_entities"](spark, d).collect()} == want
    assert len(want) == 200


def test_loading(spark, tmp_path):
    assert loading.sniff(b"%PDF-1.4") == "pdf" and loading.sniff(b"text", "s3://b/a.TXT?x=1") == "txt" and loading.sniff(b"text") is None
    assert loading.html_text("<head><title>t</title></head><p>a <b>b</b></p><script>x</script><p>c") == "a b\nc"
    with pytest.raises(ValueError):
        loading.parse_value(b"x", None, "none")
    good = tmp_path / "a.md"
    good.write_text("# hi")
    df = spark.createDataFrame([(1, str(good)), (2, str(tmp_path / "missing.txt"))], "id int, url string")
    got = loading.payload(df, {"implementation": "uri", "column_name": "url"}, {"implementation": "auto"}).orderBy("id").collect()
    assert got[0]["_payload"] == "# hi" and "FileNotFoundError" in got[1]["_load_error"]
