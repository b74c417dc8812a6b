"""Questions to SQL: search for context, let a model answer, check the answer by analysis alone, and repair it."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import functions as F
from pyspark.sql import DataFrame, SparkSession

from embedlake.functions.models import query_vector
from embedlake.semantic import describe as D
from embedlake.semantic.catalog import Catalog

ITERATIONS = 10
CHECKED = re.compile(r"^\s*(with|select|insert|update|delete|merge|values)\b", re.I)
RUNNABLE = re.compile(r"^\s*(with|select|values)\b", re.I)
MODES = ("semantic_search", "entire_catalog", "specific_ids")


class Model(Protocol):
    """Gets prompts and the tools it may use; answers with one call of a tool."""

    def request(self, system: str, user: str, tools: Sequence[str]) -> dict: ...


@dataclass
class Context:
    objects: dict[int, str] = field(default_factory=dict)
    examples: dict[int, str] = field(default_factory=dict)
    facts: dict[int, str] = field(default_factory=dict)

    def kinds(self) -> dict[str, dict[int, str]]:
        return {"objects": self.objects, "examples": self.examples, "facts": self.facts}

    def text(self) -> str:
        return "\n\n".join(t for found in self.kinds().values() for t in found.values())


@dataclass
class Answer:
    sql: str
    context: Context
    iterations: int
    error: str | None = None
    messages: list[str] = field(default_factory=list)


def validate(spark: SparkSession, sql: str) -> str | None:
    """What is wrong with a statement, found by parsing and analysis; None if nothing is. Nothing runs."""
    if not CHECKED.match(sql):
        return None
    try:
        state = spark._jsparkSession.sessionState()
        parsed = state.sqlParser().parsePlan(sql)
        mode = spark._jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()
        state.executePlan(parsed, mode).assertAnalyzed()
    except Exception as e:
        return str(e).split("\n\tat ")[0].split("\nJVM stacktrace")[0]
    return None


def run(spark: SparkSession, sql: str) -> DataFrame:
    """A checked query's result; only statements that read may run."""
    if not RUNNABLE.match(sql):
        raise PermissionError("only SELECT and VALUES may run")
    wrong = validate(spark, sql)
    if wrong:
        raise ValueError(wrong)
    return spark.sql(sql)


def _render(catalog: Catalog, kind: str, rows, renderers: dict) -> dict[int, str]:
    out = {}
    for r in rows:
        if kind == "facts":
            out[r["id"]] = D.render_fact(r["id"], r["description"])
        elif kind == "examples":
            out[r["id"]] = D.render_example(r["id"], r["sql"], r["description"])
        elif r["objtype"] in ("table", "view", "column", "view column"):
            full = f"{r['schema_name']}.{r['name']}"
            if catalog.spark.catalog.tableExists(full):
                about = {x["column_name"]: x["description"] for x in catalog.rows("objects").where((F.col("schema_name") == r["schema_name"]) & (F.col("name") == r["name"])).collect()}
                shown = D.load(catalog.spark, full, about, renderers.get("sample_size", 0))
                shown.id = r["id"]
                out[r["id"]] = D.render_relation(shown)
        else:
            out[r["id"]] = f"<{r['objtype']} id=\"{r['id']}\">\n{r['schema_name']}.{r['name']}({', '.join(r['args'] or [])}): {r['description']}\n</{r['objtype']}>"
    return out


def fetch(catalog: Catalog, embedding: str, prompt: str, context: Context, limit: int = 5, max_distance: float | None = None, **renderers) -> Context:
    """``context`` with what is near to ``prompt`` and not in it yet; the prompt is embedded once."""
    q = query_vector(prompt, catalog.embeddings[embedding])
    for kind, known in context.kinds().items():
        rows = catalog.search(kind, embedding, q, limit, list(known), max_distance).collect()
        known.update(_render(catalog, kind, rows, renderers))
    return context


def initial(catalog: Catalog, embedding: str, prompt: str, mode: str = "semantic_search", ids: dict[str, Sequence[int]] | None = None, **more) -> Context:
    if mode not in MODES:
        raise ValueError(f"unknown context mode: {mode}")
    context = Context()
    if mode == "semantic_search":
        return fetch(catalog, embedding, prompt, context, **more)
    for kind, known in context.kinds().items():
        rows = catalog.list(kind, ids=(ids or {}).get(kind, []) if mode == "specific_ids" else None)
        if kind == "objects" and mode == "entire_catalog":
            rows = rows.where("column_name is null")
        known.update(_render(catalog, kind, rows.collect(), more))
    return context


SYSTEM = "You write one Spark SQL statement that answers the question from the objects, examples and facts given."


def _user(prompt: str, context: Context, answer: str | None, error: str | None) -> str:
    out = [context.text(), f"Question: {prompt}"]
    if error:
        out.append(f"The last answer was\n{answer}\nIt is not valid: {error}\nCorrect it.")
    return "\n\n".join(out)


def generate_sql(catalog: Catalog, embedding: str, model: Model, prompt: str, iterations: int = ITERATIONS, mode: str = "semantic_search", ids: dict | None = None, **more) -> Answer:
    """Let ``model`` answer within ``iterations`` turns. It may ask for more context, but not in the last one."""
    context = initial(catalog, embedding, prompt, mode, ids, **more)
    said: list[str] = []
    answer = error = None
    for k in range(iterations):
        tools = ["record_sql_answer"] if k == iterations - 1 else ["search_for_context", "record_sql_answer"]
        user = _user(prompt, context, answer, error)
        said.append(user)
        call = model.request(SYSTEM, user, tools)
        if call["tool"] == "search_for_context" and "search_for_context" in tools:
            for question in call["questions"]:
                fetch(catalog, embedding, question, context, **more)
            continue
        answer = call["sql"]
        error = validate(catalog.spark, answer)
        if error is None:
            for kind, known in context.kinds().items():
                wanted = call.get(f"relevant_{kind}")
                if wanted is not None:
                    for id in [i for i in known if i not in wanted]:
                        del known[id]
                if known:
                    catalog.used(kind, list(known))
            return Answer(answer, context, k + 1, messages=said)
    return Answer(answer or "", context, iterations, error or "no answer within the limit", said)


class KeywordModel:
    """Offline: selects all rows of the table whose rendering shares the most words with the question."""

    def request(self, system: str, user: str, tools: Sequence[str]) -> dict:
        question = user.rsplit("Question: ", 1)[-1].split("\n\n")[0]
        words = set(re.findall(r"\w+", question.lower()))
        found = re.findall(r'<(?:table|view) id="(\d+)">\nCREATE (?:TABLE|VIEW) (\S+)(.*?)</(?:table|view)>', user, re.S)
        best = max(found, key=lambda f: len(words & set(re.findall(r"[a-z0-9]+", (f[1] + f[2]).lower()))), default=None)
        return {"tool": "record_sql_answer", "sql": f"SELECT * FROM {best[1]}" if best else "VALUES (1)", "relevant_objects": [int(best[0])] if best else []}
