"""A searchable catalogue of tables, views, functions, examples and facts, kept as versioned tables.

Objects: id, objtype (table, column, view, ...), schema_name, name, column_name, args, description, usage.
Examples: id, sql, description. Facts: id, description. Each has an array column per embedding.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embedlake.functions.models import embed, query_vector
from embedlake.operators.knn import top_k
from embedlake.operators.words import WordIndex, fused
from embedlake.plans.store import Table
from embedlake.semantic import describe, renames

NAME = re.compile(r"[a-z][a-z_0-9]*")
SCHEMA_VERSION = "1"
OBJECT_TYPES = ("table", "view", "function", "procedure", "aggregate", "column", "view column")
KINDS = {
    "objects": "id long, objtype string, schema_name string, name string, column_name string, args array<string>, description string, usage long",
    "examples": "id long, sql string, description string, usage long", "facts": "id long, description string, usage long",
}


def content(kind: str) -> Column:
    """The text that is embedded for a row."""
    if kind == "facts":
        return F.col("description")
    if kind == "examples":
        return F.concat(F.col("description"), F.lit(" \n<sql>\n"), F.col("sql"), F.lit("\n</sql>"))
    dotted = F.concat_ws(".", F.col("schema_name"), F.col("name"), F.col("column_name"))
    call = F.concat(dotted, F.lit("("), F.array_join("args", ", "), F.lit(")"))
    return F.concat_ws(" ", F.when(F.size("args") > 0, call).otherwise(dotted), F.col("description"))


@dataclass
class Catalog:
    spark: SparkSession
    path: str
    name: str = "default"
    embeddings: dict[str, dict] = field(default_factory=dict)

    def __post_init__(self):
        if not NAME.fullmatch(self.name):
            raise ValueError(f"invalid catalog name: {self.name}")

    def _table(self, kind: str) -> Table:
        return Table(self.spark, f"{self.path}/{self.name}/{kind}")

    def rows(self, kind: str) -> DataFrame:
        t = self._table(kind)
        if t.exists():
            return t.read()
        extra = "".join(f", `{e}` array<float>" for e in self.embeddings)
        return self.spark.createDataFrame([], KINDS[kind] + extra)

    def add_embedding(self, config: dict, name: str | None = None) -> str:
        """A new embedding; named ``embN``, one above the largest there is, unless given."""
        if name is None:
            numbers = [int(m[0]) for n in self.embeddings if (m := re.search(r"[0-9]+$", n))]
            name = f"emb{max([len(self.embeddings), *numbers]) + 1}"
        if not NAME.fullmatch(name):
            raise ValueError(f"invalid embedding name: {name}")
        self.embeddings[name] = config
        for kind in KINDS:
            t = self._table(kind)
            if t.exists():
                t.write(t.read().withColumn(name, F.lit(None).cast("array<float>")))
        return name

    def drop_embedding(self, name: str) -> None:
        del self.embeddings[name]
        for kind in KINDS:
            t = self._table(kind)
            if t.exists():
                t.write(t.read().drop(name))

    def _merge(self, kind: str, new: DataFrame, on: Sequence[str]) -> None:
        """Upsert by ``on``; what is embedded anew loses its vectors, compared null-safely. New ids follow the order of ``new``."""
        old = self.rows(kind)
        cols = [c for c in new.columns if c != "id"]
        start = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
        # numbers in the order of rows: positions within partitions, and how many rows the partitions before have
        placed = self._table(f"{kind}-new")
        placed.write(new.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
        counts, before = {r["_p"]: r["count"] for r in placed.read().groupBy("_p").count().collect()}, {}
        for part in sorted(counts):  # a number a partition
            before[part] = start + 1 + sum(counts[q] for q in before)
        first = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("_p")) if before else F.lit(0)
        fresh = placed.read().select((first + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"), *cols)
        o, n = old.alias("o"), fresh.alias("n")
        cond = F.lit(True)
        for c in on:
            cond = cond & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
        has = F.col("n.id").isNotNull()
        same = F.lit(True)
        for c in cols:
            if c != "usage":
                same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
        pick = [F.coalesce("o.id", "n.id").alias("id")]
        for f in old.schema:
            if f.name in cols and f.name != "usage":
                pick.append(F.when(has, F.col(f"n.{f.name}")).otherwise(F.col(f"o.{f.name}")).alias(f.name))
            elif f.name in self.embeddings:
                pick.append(F.when(~has | same, F.col(f"o.{f.name}")).alias(f.name))
            elif f.name == "usage":
                pick.append(F.coalesce("o.usage", F.lit(0)).cast("long").alias("usage"))
        self._table(kind).write(o.join(n, cond, "full_outer").select(*pick))

    def set_description(self, objtype: str, schema: str, name: str, description: str, column: str | None = None, args: Sequence[str] = ()) -> None:
        if objtype not in OBJECT_TYPES:
            raise ValueError(f"unknown object type: {objtype}")
        row = self.spark.createDataFrame([(objtype, schema, name, column, list(args), description)], "objtype string, schema_name string, name string, column_name string, args array<string>, description string")
        self._merge("objects", row, ["schema_name", "name", "column_name", "args"])

    def set_descriptions(self, rows: DataFrame) -> None:
        """Many at once: objtype, schema_name, name, column_name, args, description; one change of the table."""
        bad = rows.where(~F.col("objtype").isin(list(OBJECT_TYPES))).first()
        if bad is not None:
            raise ValueError(f"unknown object type: {bad['objtype']}")
        self._merge("objects", rows.select("objtype", "schema_name", "name", "column_name", "args", "description"), ["schema_name", "name", "column_name", "args"])

    def add_example(self, sql: str, description: str) -> None:
        self._merge("examples", self.spark.createDataFrame([(sql, description)], "sql string, description string"), ["sql", "description"])

    def add_fact(self, description: str) -> None:
        self._merge("facts", self.spark.createDataFrame([(description,)], "description string"), ["description"])

    def update(self, kind: str, id: int, **values: str) -> None:
        rows = self.rows(kind)
        if rows.where(F.col("id") == id).isEmpty():
            raise LookupError(f"{kind} {id} not found")
        here = F.col("id") == id
        for c, v in values.items():
            rows = rows.withColumn(c, F.when(here, F.lit(v)).otherwise(F.col(c)))
        for e in self.embeddings:
            rows = rows.withColumn(e, F.when(~here, F.col(e)))
        self._table(kind).write(rows)

    def drop(self, kind: str, id: int) -> None:
        rows = self.rows(kind)
        if rows.where(F.col("id") == id).isEmpty():
            raise LookupError(f"{kind} {id} not found")
        self._table(kind).write(rows.where(F.col("id") != id))

    def list(self, kind: str, objtype: str | None = None, ids: Sequence[int] | None = None) -> DataFrame:
        rows = self.rows(kind)
        if objtype is not None:
            rows = rows.where(F.col("objtype") == objtype)
        return (rows if ids is None else rows.where(F.col("id").isin(list(ids)))).orderBy("id")

    def vectorize(self, name: str) -> int:
        """Embed the rows that have no vector yet; returns how many there were."""
        done = 0
        for kind in KINDS:
            t = self._table(kind)
            if not t.exists():
                continue
            rows = t.read()
            n = rows.where(F.col(name).isNull()).count()
            if n:
                new = rows.where(F.col(name).isNull()).withColumn(name, embed(content(kind), self.embeddings[name]))
                t.write(rows.where(F.col(name).isNotNull()).unionByName(new))
            done += n
        return done

    def search(self, kind: str, name: str, query: str | Sequence[float], limit: int = 5, exclude: Sequence[int] = (), max_distance: float | None = None, allowed: Column | None = None) -> DataFrame:
        """The nearest rows of a kind, of those that are ``allowed``."""
        q = query_vector(query, self.embeddings[name]) if isinstance(query, str) else query
        rows = self.rows(kind).where(F.col(name).isNotNull())
        return top_k(rows, q, limit, ["id"], name, where=allowed, exclude=list(exclude), max_distance=max_distance)

    def search_owners(self, name: str, query: str | Sequence[float], limit: int = 5, max_distance: float | None = None, allowed: Column | None = None) -> DataFrame:
        """Objects that own the nearest objects or columns, once each."""
        hits = self.search("objects", name, query, limit, max_distance=max_distance, allowed=allowed)
        owners = hits.groupBy(F.col("schema_name").alias("s"), F.col("name").alias("n")).agg(F.min("distance").alias("distance"))
        rows = self.rows("objects").where("column_name is null")
        return rows.join(owners, (rows["schema_name"] == owners["s"]) & (rows["name"] == owners["n"])).drop("s", "n").orderBy("distance", "id")

    def search_words(self, kind: str, words: Sequence[str], limit: int = 5) -> DataFrame:
        """Rows whose text has the most of ``words``."""
        text = F.lower(content(kind))
        rank = sum((F.when(text.rlike(rf"(?i)(?<!\w){re.escape(w)}(?!\w)"), 1).otherwise(0) for w in words), F.lit(0))
        return self.rows(kind).withColumn("rank", rank).where("rank > 0").orderBy(F.desc("rank"), "id").limit(limit)

    def index_words(self, kind: str) -> WordIndex:
        """Write the postings of a kind's texts anew."""
        index = WordIndex(self.spark, f"{self.path}/words-{kind}")
        index.build(self.rows(kind).select("id", content(kind).alias("text")), "id", "text")
        return index

    def search_ranked(self, kind: str, name: str, query: str, limit: int = 5, allowed: Column | None = None) -> DataFrame:
        """Rows by both rankings, by vector and by the words of ``query`` in the index of ``index_words``; with ``score``."""
        ids = None if allowed is None else self.rows(kind).where(allowed).select("id")
        near = self.search(kind, name, query, 4 * limit, allowed=allowed).select("id", F.col("distance").alias("_by"))
        said = WordIndex(self.spark, f"{self.path}/words-{kind}").search(query, 4 * limit, only=ids).select("id", (-F.col("score")).alias("_by"))
        return self.rows(kind).join(fused([near, said], "id", limit), "id").orderBy(F.desc("score"), "id")

    def search_hybrid(self, kind: str, name: str, query: str, words: Sequence[str], limit: int = 5) -> DataFrame:
        """Rows near by vector or by words, once each."""
        a = self.search(kind, name, query, limit).drop("distance")
        return a.unionByName(self.search_words(kind, words, limit).drop("rank")).dropDuplicates(["id"])

    def used(self, kind: str, ids: Sequence[int]) -> None:
        """Count a use of each row."""
        rows = self.rows(kind)
        self._table(kind).write(rows.withColumn("usage", F.coalesce("usage", F.lit(0)) + F.when(F.col("id").isin(list(ids)), 1).otherwise(0)))

    def frequently_used(self, n: int = 20) -> DataFrame:
        return self.rows("objects").where("usage > 0").orderBy(F.desc("usage"), "id").limit(n)

    def export_yaml(self) -> str:
        """All rows as YAML documents, behind a header."""
        docs: list[dict] = [{"type": "header", "schema_version": SCHEMA_VERSION}]
        rows = self.rows("objects").orderBy("id").collect()
        for r in rows:
            if r["column_name"] is not None:
                continue
            doc = {"schema": r["schema_name"], "name": r["name"], "type": r["objtype"]}
            if r["objtype"] in ("function", "procedure", "aggregate"):
                doc["args"] = list(r["args"] or [])
            doc["description"] = r["description"]
            if r["objtype"] in ("table", "view"):
                doc["columns"] = [{"name": c["column_name"], "description": c["description"]} for c in rows if c["column_name"] is not None and (c["schema_name"], c["name"]) == (r["schema_name"], r["name"])]
            docs.append(doc)
        docs += [{"type": "sql_example", "id": r["id"], "sql": r["sql"], "description": r["description"]} for r in self.rows("examples").orderBy("id").collect()]
        docs += [{"type": "fact", "id": r["id"], "description": r["description"]} for r in self.rows("facts").orderBy("id").collect()]
        return "".join(yaml.safe_dump(d, explicit_start=True, explicit_end=True, sort_keys=False, allow_unicode=True) for d in docs)

    def import_yaml(self, text: str) -> int:
        """Add or update all rows of YAML documents; the first has to be a header of this version."""
        docs = [d for d in yaml.safe_load_all(text) if d is not None]
        if not docs or docs[0].get("type") != "header":
            raise ValueError("the first document must be a header")
        if docs[0].get("schema_version") != SCHEMA_VERSION:
            raise ValueError(f"unsupported schema_version: {docs[0].get('schema_version')}")
        objects, examples, facts = [], [], []
        for d in docs[1:]:
            if d["type"] == "fact":
                facts.append((d["description"],))
            elif d["type"] == "sql_example":
                examples.append((d["sql"], d["description"]))
            else:
                objects.append((d["type"], d["schema"], d["name"], None, list(d.get("args", [])), d["description"]))
                objects += [("column" if d["type"] == "table" else "view column", d["schema"], d["name"], c["name"], [], c["description"]) for c in d.get("columns", [])]
        if objects:
            self._merge("objects", self.spark.createDataFrame(objects, "objtype string, schema_name string, name string, column_name string, args array<string>, description string"), ["schema_name", "name", "column_name", "args"])
        if examples:
            self._merge("examples", self.spark.createDataFrame(examples, "sql string, description string"), ["sql", "description"])
        if facts:
            self._merge("facts", self.spark.createDataFrame(facts, "description string"), ["description"])
        return len(docs) - 1

    def _described(self) -> list[str]:
        rows = self.rows("objects").where(F.col("objtype").isin("table", "view", "column", "view column"))
        return [f"{r[0]}.{r[1]}" for r in rows.select("schema_name", "name").distinct().orderBy("schema_name", "name").collect()]

    def remember(self, names: Sequence[str] | None = None) -> None:
        """Keep what relations look like, all that are described unless named, so that ``refresh`` knows them under other names."""
        names = [n for n in (self._described() if names is None else names) if self.spark.catalog.tableExists(n)]
        now = renames.snapshot(self.spark, {n: self.spark.table(n) for n in names})
        t = self._table("relations")
        if t.exists():
            now = now.unionByName(t.read().where(~F.concat_ws(".", "schema_name", "name").isin(names)))
        t.write(now)

    def renamed(self) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
        """(kind, old, new) of relations and (relation, kind, old, new) of columns since ``remember``; kinds are rename and ambiguous.

        Also the names of relations that are gone, and of those that have other columns now.
        """
        before, there = self._table("relations").read(), self.spark.catalog.tableExists
        full = F.concat_ws(".", "schema_name", "name")
        known = {}
        for r in before.groupBy(full.alias("full")).agg(F.array_sort(F.collect_list(F.concat_ws(" ", "column_name", "type"))).alias("columns")).collect():
            known[r["full"]] = r["columns"]
        gone = [n for n in known if not there(n)]
        # relations that stay and have other columns now
        seen = {n: self.spark.table(n) for n in known if n not in gone}
        changed = {n: df for n, df in seen.items() if sorted(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) != known[n]}
        new = {n: self.spark.table(n) for kind in ("table", "view") for n in describe.find(self.spark, kind) if n not in known} if gone else {}
        t = self._table("relations-now")
        t.write(renames.snapshot(self.spark, new | changed))
        after = t.read()
        moved = renames.relations(before.where(full.isin(gone)), after.where(full.isin(list(new)))).persist()
        same = self.spark.createDataFrame([(n, n) for n in changed], "old string, new string")
        return moved, renames.columns(before, after, moved.where("kind = 'rename'").select("old", "new").unionByName(same)), gone, list(changed)

    def _rename(self, moved: DataFrame, columns: DataFrame) -> None:
        """Give the described objects their new names; their texts have changed, so they are embedded anew."""
        rows = self.rows("objects")
        at = F.regexp_extract("new", r"^(.*)\.([^.]*)$", 1), F.regexp_extract("new", r"^(.*)\.([^.]*)$", 2)
        of = moved.where("kind = 'rename'").select(F.col("old").alias("_full"), at[0].alias("_schema"), at[1].alias("_name"))
        own = columns.where("kind = 'rename'").select(F.col("relation").alias("_now"), F.col("old").alias("_old"), F.col("new").alias("_column"))
        watched = F.col("objtype").isin("table", "view", "column", "view column")
        joined = rows.withColumn("_full", F.when(watched, F.concat_ws(".", "schema_name", "name"))).join(of, "_full", "left")
        joined = joined.withColumn("_now", F.coalesce(F.when(F.col("_name").isNotNull(), F.concat_ws(".", "_schema", "_name")), "_full"))
        joined = joined.join(own, (joined["_now"] == own["_now"]) & (joined["column_name"] == own["_old"]), "left")
        new = {"schema_name": "_schema", "name": "_name", "column_name": "_column"}
        touched = F.col("_name").isNotNull() | F.col("_column").isNotNull()
        pick = [F.coalesce(new[c], c).alias(c) if c in new else F.when(~touched, F.col(c)).alias(c) if c in self.embeddings else F.col(c) for c in rows.columns]
        self._table("objects").write(joined.select(*pick))

    def refresh(self, dry_run: bool = False) -> list[tuple[str, str]]:
        """Reconcile with the session's catalogue: rows of tables and columns that are gone are dropped.

        What ``remember`` has kept is looked for under other names first: renamed ones keep their descriptions, and
        ambiguous ones are reported and stay.
        """
        actions: list[tuple[str, str]] = []
        keep, spared = [], set()
        if self._table("relations").exists():
            moved, columns, gone, changed = self.renamed()
            found = [(r["kind"], r["old"], r["new"]) for r in moved.orderBy("old").collect()]  # a row a change
            back = {new: old for kind, old, new in found if kind == "rename"}
            inner = [(r["kind"], r["relation"], r["old"], r["new"]) for r in columns.orderBy("relation", "old").collect()]
            actions += [(kind, f"{old} -> {new}" if new else old) for kind, old, new in found]
            actions += [(kind, f"{rel}.{old} -> {new}" if new else f"{rel}.{old}") for kind, rel, old, new in inner]
            spared = {old for kind, old, new in found if kind == "ambiguous" or dry_run} | {f"{rel}.{old}" for kind, rel, old, _ in inner if kind == "ambiguous" or dry_run}
            if not dry_run:
                self._rename(moved, columns)
                if gone:
                    t = self._table("relations")
                    t.write(t.read().where(~F.concat_ws(".", "schema_name", "name").isin([n for n in gone if n not in spared])))
                if back or changed:
                    self.remember([*back, *changed])
            moved.unpersist()
        for r in self.rows("objects").where(F.col("objtype").isin("table", "view", "column", "view column")).collect():
            full = f"{r['schema_name']}.{r['name']}"
            there = self.spark.catalog.tableExists(full)
            column = f"{full}.{r['column_name']}" if r["column_name"] else full
            if full in spared or column in spared or there and (r["column_name"] is None or r["column_name"] in self.spark.table(full).columns):
                keep.append(r["id"])
            else:
                actions.append(("delete", column))
        if any(a == "delete" for a, _ in actions) and not dry_run:
            rows = self.rows("objects")
            watched = F.col("objtype").isin("table", "view", "column", "view column")
            self._table("objects").write(rows.where(~watched | F.col("id").isin(keep)))
        return actions
