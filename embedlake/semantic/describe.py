"""Finding, loading, sampling, rendering and describing the objects of a session's catalogue."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Column:
    name: str
    type: str
    is_not_null: bool = False
    default_value: str | None = None
    description: str | None = None


@dataclass
class Relation:
    schema_name: str
    name: str
    columns: list[Column]
    kind: str = "table"
    id: int = 0
    description: str | None = None
    definition: str | None = None
    constraints: list[tuple[str, str]] = field(default_factory=list)
    indexes: list[str] = field(default_factory=list)
    dimensions: list[dict] = field(default_factory=list)
    sample: str | None = None
    persistence: str | None = None
    is_materialized: bool = False


@dataclass
class Procedure:
    schema_name: str
    name: str
    identity_args: str
    definition: str
    kind: str = "function"
    id: int = 0
    description: str | None = None


def find(spark: SparkSession, kind: str = "table", include_schema: str | None = None, exclude_schema: str | None = None, include: str | None = None, exclude: str | None = None) -> list[str]:
    """Full names of tables, views or functions whose schema and name match."""
    out = []
    for db in spark.catalog.listDatabases():
        if (include_schema and not re.search(include_schema, db.name)) or (exclude_schema and re.search(exclude_schema, db.name)):
            continue
        if kind == "function":
            names = [f.name for f in spark.catalog.listFunctions(db.name) if f.className and "org.apache.spark.sql.catalyst" not in f.className]
        else:
            names = [t.name for t in spark.catalog.listTables(db.name) if (t.tableType == "VIEW") == (kind == "view") and t.tableType != "TEMPORARY"]
        out += [f"{db.name}.{n}" for n in names if not (include and not re.search(include, n)) and not (exclude and re.search(exclude, n))]
    return sorted(out)


def load(spark: SparkSession, name: str, descriptions: dict[str | None, str] | None = None, sample_size: int = 0) -> Relation:
    """A table or view with its columns, descriptions and a sample."""
    df = spark.table(name)
    space, _, own = name.rpartition(".")
    about = descriptions or {}
    info = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    view = info.get("Type") == "VIEW"
    columns = [Column(f.name, f.dataType.simpleString(), not f.nullable, None, about.get(f.name) or f.metadata.get("comment")) for f in df.schema]
    return Relation(space or "default", own, columns, "view" if view else "table", 0, about.get(None), info.get("View Text"), sample=sample(df, name, sample_size) if sample_size else None)


def load_all(spark: SparkSession, names: list[str], descriptions: dict[str, dict[str | None, str]] | None = None, sample_size: int = 0) -> list[Relation]:
    """Relations with the keys and references that their rows show, see ``keys.constraints``."""
    from embedlake.semantic import keys

    found = keys.constraints({n: spark.table(n) for n in names})
    out = []
    for n in names:
        r = load(spark, n, (descriptions or {}).get(n), sample_size)
        own = n.rpartition(".")[2]
        r.constraints = [(f"{own}_{'key' if d.startswith('UNIQUE') else 'fk'}{k}", d) for k, d in enumerate(found[n], 1)]
        out.append(r)
    return out


def _sql_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def sample(df: DataFrame, name: str, n: int = 3, format: str = "copy_text") -> str:
    """The first 1 to 10 rows as COPY text or as an INSERT."""
    rows = df.limit(min(max(n, 1), 10)).collect()
    names = ", ".join(df.columns)
    if format == "insert":
        values = "\n, ".join("(" + ", ".join(_sql_value(v) for v in r) + ")" for r in rows)
        return f"INSERT INTO {name} ({names})\nVALUES\n  {values};"
    fixed = lambda v: r"\N" if v is None else str(v).replace("\\", "\\\\").replace("\t", r"\t").replace("\n", r"\n")
    return f"COPY (SELECT * FROM {name} LIMIT {len(rows)}) TO STDOUT WITH (FORMAT TEXT, HEADER true);\n" + "\n".join(["\t".join(df.columns), *("\t".join(fixed(v) for v in r) for r in rows)])


def _quoted(text: str) -> str:
    return f"$${text}$$"


def render_relation(r: Relation) -> str:
    """A table or view as DDL with comments, in a tag."""
    full = f"{r.schema_name}.{r.name}"
    out = [f'<{r.kind} id="{r.id}">']
    if r.kind == "table":
        cols = [" ".join(x for x in (c.name, c.type, "NOT NULL" if c.is_not_null else "", c.default_value or "") if x) for c in r.columns]
        out += [f"CREATE {r.persistence.upper() + ' ' if r.persistence else ''}TABLE {full}", "( " + "\n, ".join(cols), ");"]
        out += [f"ALTER TABLE {full} ADD CONSTRAINT {n} {d};" for n, d in r.constraints] + [f"{i};" for i in r.indexes]
    else:
        out += [f"CREATE {'MATERIALIZED ' if r.is_materialized else ''}VIEW {full} AS", (r.definition or "").rstrip(), "/* column types"]
        out += [f"{c.name} {c.type}" for c in r.columns] + ["*/"]
    word = r.kind.upper()
    if r.description is not None:
        out.append(f"COMMENT ON {word} {full} IS {_quoted(r.description)};")
    out += [f"COMMENT ON COLUMN {full}.{c.name} IS {_quoted(c.description)};" for c in r.columns if c.description is not None]
    out += [f"/* partitioned {d['builder']}({d['column']}, {d.get('interval') or d.get('number')}) */" for d in r.dimensions]
    if r.sample:
        out.append(r.sample)
    return "\n".join([*out, f"</{r.kind}>"])


def render_procedure(p: Procedure) -> str:
    out = [f'<{p.kind} id="{p.id}">', f"{p.definition};"]
    if p.description is not None:
        out.append(f"COMMENT ON {p.kind.upper()} {p.schema_name}.{p.name}({p.identity_args}) IS {_quoted(p.description)};")
    return "\n".join([*out, f"</{p.kind}>"])


def render_fact(id: int, description: str) -> str:
    return f'<fact id="{id}">\n{description}\n</fact>'


def render_example(id: int, sql: str, description: str) -> str:
    return f'<sql-example id="{id}">\n/*\n{description}\n*/\n{sql}\n</sql-example>'


def offline_describer(r: Relation) -> dict[str | None, str]:
    """Descriptions from names and types alone."""
    out: dict[str | None, str] = {None: f"Holds {r.name.replace('_', ' ')} rows with {len(r.columns)} columns."}
    return out | {c.name: f"{c.name.replace('_', ' ')} ({c.type})" for c in r.columns}


def describe(spark: SparkSession, names: Sequence[str], catalog, describer: Callable[[Relation], dict] = offline_describer, sample_size: int = 3, batch: int = 5) -> int:
    """Record descriptions of relations, ``batch`` of them at a time; returns how many texts were recorded."""
    done = 0
    columns = "objtype string, schema_name string, name string, column_name string, args array<string>, description string"
    for a in range(0, len(names), batch):
        rows = []
        for name in names[a : a + batch]:
            r = load(spark, name, sample_size=sample_size)
            for column, text in describer(r).items():
                kind = r.kind if column is None else ("column" if r.kind == "table" else "view column")
                rows.append((kind, r.schema_name, r.name, column, [], text))
        if rows:
            catalog.set_descriptions(spark.createDataFrame(rows, columns))
        done += len(rows)
    return done
