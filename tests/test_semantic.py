import pytest

from embedlake.config import embedding_hash
from embedlake.semantic import describe as D
from embedlake.semantic import text2sql as Q
from embedlake.semantic.catalog import Catalog


@pytest.fixture
def catalog(spark, folder):
    spark.sql("CREATE DATABASE IF NOT EXISTS air")
    spark.sql("DROP TABLE IF EXISTS air.airport")
    spark.sql("CREATE TABLE air.airport (code STRING COMMENT 'IATA code', intnl BOOLEAN) USING parquet")
    spark.sql("INSERT INTO air.airport VALUES ('TXL', true), ('XXX', NULL)")
    c = Catalog(spark, folder)
    c.add_embedding(embedding_hash(8))
    return c


def test_manage(spark, catalog):
    catalog.set_description("table", "air", "airport", "airports")
    catalog.set_description("column", "air", "airport", "is it international", "intnl")
    catalog.add_fact("planes fly")
    catalog.add_example("SELECT 1", "one")
    assert catalog.vectorize("emb1") == 4 and catalog.vectorize("emb1") == 0
    catalog.set_description("table", "air", "airport", "all airports")  # a new text is embedded anew
    assert catalog.vectorize("emb1") == 1
    assert catalog.list("objects", "table").first()["description"] == "all airports" and catalog.rows("objects").count() == 2
    hit = catalog.search("facts", "emb1", "planes fly", 1).first()
    assert abs(hit["distance"]) < 1e-6
    assert [r["name"] for r in catalog.search_owners("emb1", "air.airport.intnl is it international", 1).collect()] == ["airport"]
    assert catalog.search("facts", "emb1", "planes fly", exclude=[hit["id"]]).count() == 0
    assert catalog.search_words("facts", ["planes"]).count() == 1 and catalog.search_hybrid("facts", "emb1", "x", ["planes"]).count() == 1
    text = catalog.export_yaml()
    other = Catalog(spark, catalog.path, "other", dict(catalog.embeddings))
    assert other.import_yaml(text) == 3 and other.export_yaml() == text
    with pytest.raises(ValueError):
        other.import_yaml("---\ntype: fact\ndescription: x\n")
    other.set_description("table", "air", "gone", "no such table")
    assert other.refresh(dry_run=True) == [("delete", "air.gone")] and other.refresh() and other.refresh() == []
    catalog.used("facts", [hit["id"]])
    catalog.drop("facts", hit["id"])
    with pytest.raises(LookupError):
        catalog.drop("facts", 99)
    with pytest.raises(ValueError):
        Catalog(spark, catalog.path, "Bad Name")
    assert catalog.add_embedding(embedding_hash(4)) == "emb2" and "emb2" in catalog.rows("objects").columns


def test_render(spark, catalog):
    r = D.load(spark, "air.airport", {None: "airports"}, 1)
    assert D.render_relation(r).startswith('<table id="0">\nCREATE TABLE air.airport\n( code string\n, intnl boolean\n);\nCOMMENT ON TABLE air.airport IS $$airports$$;\nCOMMENT ON COLUMN air.airport.code IS $$IATA code$$;\nCOPY')
    golden = D.Relation("postgres_air", "aircraft", [D.Column("model", "text"), D.Column("code", "text", True)], constraints=[("aircraft_pkey", "PRIMARY KEY (code)")])
    assert D.render_relation(golden) == '<table id="0">\nCREATE TABLE postgres_air.aircraft\n( model text\n, code text NOT NULL\n);\nALTER TABLE postgres_air.aircraft ADD CONSTRAINT aircraft_pkey PRIMARY KEY (code);\n</table>'
    assert D.sample(spark.table("air.airport").where("code = 'XXX'"), "air.airport", 1, "insert") == "INSERT INTO air.airport (code, intnl)\nVALUES\n  ('XXX', NULL);"
    assert D.find(spark, "table", include_schema="^air$") == ["air.airport"] and D.describe(spark, ["air.airport"], catalog) == 3


class Scripted:
    def __init__(self, *calls):
        self.calls = list(calls)

    def request(self, system, user, tools):
        return self.calls.pop(0)


def test_text_to_sql(spark, catalog):
    catalog.set_description("table", "air", "airport", "airports")
    catalog.vectorize("emb1")
    id = catalog.rows("objects").first()["id"]
    model = Scripted(
        {"tool": "search_for_context", "questions": ["airports"]}, {"tool": "record_sql_answer", "sql": "SELECT nope FROM air.airport"},
        {"tool": "record_sql_answer", "sql": "SELECT code FROM air.airport WHERE intnl", "relevant_objects": [id]},
    )
    got = Q.generate_sql(catalog, "emb1", model, "which airports are international?")
    assert got.error is None and got.iterations == 3 and "not valid" in got.messages[-1] and list(got.context.objects) == [id]
    assert Q.run(spark, got.sql).collect()[0]["code"] == "TXL" and catalog.rows("objects").first()["usage"] == 1
    assert Q.validate(spark, "SELEC 1 FRM") is None and Q.validate(spark, "SELECT 1 FRM x y") and Q.validate(spark, "DELETE FROM nope")
    with pytest.raises(PermissionError):
        Q.run(spark, "DROP TABLE air.airport")
    bad = Q.generate_sql(catalog, "emb1", Scripted(*[{"tool": "record_sql_answer", "sql": "SELECT x"}] * 2), "q", iterations=2)
    assert bad.error
    assert Q.generate_sql(catalog, "emb1", Q.KeywordModel(), "list airport codes", mode="entire_catalog").sql == "SELECT * FROM air.airport"
