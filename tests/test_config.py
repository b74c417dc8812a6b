import pytest
from pyspark.sql import types as T

from embedlake import config as C

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("body", T.StringType()), T.StructField("doc", T.BinaryType()), T.StructField("n", T.IntegerType())])


def test_defaults_and_roundtrip():
    got = C.vectorizer("website.blog", SCHEMA, ["id"], C.loading_column("body"), C.embedding_openai("text-embedding-3-small", 768))
    assert got["destination"] == {"implementation": "table", "config_type": "destination", "target_schema": "website", "target_table": "blog_embedding_store", "view_schema": "website", "view_name": "blog_embedding"}
    assert got["chunking"]["chunk_size"] == 800 and got["chunking"]["separators"][-1] == ""
    assert got["indexing"]["implementation"] == "none" and got["name"] == "website_blog_embedding_store"
    assert C.from_json(C.to_json(got)) == got
    assert "ai_create_vectorizer('website.blog'" in C.create_call(got)


@pytest.mark.parametrize(
    ("kind", "config", "message"),
    [
        ("chunking", [], "chunking configuration has to be a dictionary"),
        ("chunking", {"config_type": "chunking", "implementation": "bob"}, "invalid chunking config implementation"),
        ("indexing", {"config_type": "indexing"}, "indexing implementation not specified"),
        ("indexing", {"config_type": "indexing", "implementation": "grandma"}, 'invalid indexing implementation: "grandma"'),
        ("indexing", C.indexing_diskann(storage_layout="super_advanced"), "invalid storage_layout"),
        ("indexing", C.indexing_hnsw(opclass="peter"), "invalid opclass"),
        ("processing", C.processing_default(batch_size=2049), "batch_size must be less than or equal to 2048"),
        ("processing", C.processing_default(concurrency=0), "concurrency must be greater than 0"),
        ("processing", C.processing_default(concurrency=51), "concurrency must be less than or equal to 50"),
        ("formatting", C.formatting_python_template("no placeholder"), "template must contain $chunk placeholder"),
        ("loading", {"config_type": "loading", "implementation": "column", "retries": 6}, "invalid loading config, missing column_name"),
        ("loading", C.loading_column("body", -1), "invalid loading config, retries must be a non-negative integer"),
        ("loading", C.loading_uri("body", aws_role_arn="bad"), "invalid loading config, aws_role_arn must match arn:aws:iam::*:role/*"),
        ("loading", C.loading_column("nothing"), "column_name in config does not exist in the table: nothing"),
        ("scheduling", {"config_type": "scheduling", "implementation": "x"}, 'unrecognized scheduling implementation: "x"'),
        ("destination", {"config_type": "chunking"}, "invalid config_type for destination config"),
    ],
)
def test_messages(kind, config, message):
    with pytest.raises(C.ConfigError) as e:
        C.validate(kind, config, SCHEMA)
    assert str(e.value) == message


def test_combinations():
    with pytest.raises(C.ConfigError, match="a binary column needs a parser, parsing_none has none"):
        C.validate("parsing", C.parsing_none(), SCHEMA, C.loading_column("doc"))
    with pytest.raises(C.ConfigError, match="parsing_pymupdf reads binary columns only"):
        C.validate("parsing", C.parsing_pymupdf(), SCHEMA, C.loading_column("body"))
    with pytest.raises(C.ConfigError, match="chunking must be none for column destination"):
        C.validate("destination", C.destination_column("emb"), chunking=C.chunking_character_text_splitter())
    with pytest.raises(C.ConfigError, match='column named "chunk"'):
        C.validate("formatting", C.formatting_python_template(), T.StructType([T.StructField("chunk", T.StringType())]))
    with pytest.raises(C.ConfigError, match="input_type"):
        C.embedding_voyageai("voyage-3", 4, input_type="x")


def test_migration_and_settings():
    old = {"version": "0.9.0", "chunking": {"implementation": "none", "config_type": "chunking", "chunk_column": "body"}, "target_table": "t", "view_name": "v"}
    new = C.migrate(old)
    assert new["loading"]["column_name"] == "body" and new["parsing"]["implementation"] == "auto" and new["destination"]["target_table"] == "t"
    assert C.resolve(C.indexing_default(), {"indexing_default": "indexing_hnsw"})["implementation"] == "hnsw"
    assert [C.executions(n) for n in (0, 1, 50, 51, 501, 10**6)] == [0, 1, 1, 2, 10, 10]
    assert C.grant_to("bob", "fernando", default="alice, bob") == ["alice", "bob", "fernando"]
