"""Command line: run pipelines, search stores, and work with a semantic catalogue."""

from __future__ import annotations

import argparse
import json
import sys

from embedlake import config as C
from embedlake.session import session


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="embedlake")
    sub = p.add_subparsers(dest="command", required=True)
    w = sub.add_parser("worker", help="bring a store in step with its source")
    w.add_argument("--config", required=True, help="a pipeline's configuration (JSON file)")
    w.add_argument("--source", required=True, help="Parquet path of the source")
    w.add_argument("--path", required=True, help="folder of the pipeline's tables")
    w.add_argument("--once", action="store_true")
    w.add_argument("--poll-interval", type=float, default=300.0)
    m = sub.add_parser("workers", help="look after all pipelines of a registry")
    m.add_argument("--path", required=True, help="folder of the registry")
    m.add_argument("--pipeline", action="append", help="number or name; all unless given")
    m.add_argument("--once", action="store_true")
    m.add_argument("--poll-interval", type=float, default=300.0)
    m.add_argument("--concurrency", type=int, default=4)
    m.add_argument("--exit-on-error", action="store_true")
    s = sub.add_parser("search", help="nearest chunks of a store")
    s.add_argument("--config", required=True)
    s.add_argument("--path", required=True)
    s.add_argument("-k", type=int, default=5)
    s.add_argument("text")
    c = sub.add_parser("semantic-catalog").add_subparsers(dest="action", required=True)
    for name in ("describe", "vectorize", "import", "export", "search", "generate-sql", "fix"):
        a = c.add_parser(name)
        a.add_argument("--path", required=True)
        a.add_argument("--name", default="default")
        a.add_argument("--embedding", default="emb1")
        a.add_argument("--dimensions", type=int, default=64)
        if name in ("search", "generate-sql"):
            a.add_argument("prompt")
        if name in ("import", "export"):
            a.add_argument("file")
        if name == "describe":
            a.add_argument("--include-schema")
            a.add_argument("--exclude-schema")
        if name == "fix":
            a.add_argument("--dry-run", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = session()
    if args.command == "workers":
        from embedlake.plans.poll import Worker
        from embedlake.plans.registry import Registry

        which = [int(w) if w.isdigit() else w for w in args.pipeline] if args.pipeline else None
        error = Worker(Registry(spark, args.path), None, which, args.poll_interval, args.concurrency, args.exit_on_error).run(args.once)
        if error:
            print(error, file=sys.stderr)
        return 1 if error else 0
    if args.command in ("worker", "search"):
        from embedlake.plans.pipeline import Pipeline

        with open(args.config) as f:
            pipeline = Pipeline(spark, C.from_json(f.read()), args.path)
        if args.command == "search":
            from embedlake.functions.models import query_vector
            from embedlake.operators.knn import top_k

            q = query_vector(args.text, pipeline.config["embedding"])
            for r in top_k(pipeline.table("store").read(), q, args.k, [*pipeline.config["keys"], "chunk_seq"]).collect():
                print(json.dumps({"distance": r["distance"], "chunk": r["chunk"]}, ensure_ascii=False))
            return 0
        import time

        while True:
            print(json.dumps(pipeline.run(spark.read.parquet(args.source))))
            if args.once:
                return 0
            time.sleep(args.poll_interval)
    from embedlake.semantic import describe, text2sql
    from embedlake.semantic.catalog import Catalog

    catalog = Catalog(spark, args.path, args.name, {args.embedding: C.embedding_hash(args.dimensions)})
    if args.action == "describe":
        names = describe.find(spark, "table", args.include_schema, args.exclude_schema) + describe.find(spark, "view", args.include_schema, args.exclude_schema)
        print(describe.describe(spark, names, catalog))
    elif args.action == "vectorize":
        print(catalog.vectorize(args.embedding))
    elif args.action == "import":
        with open(args.file) as f:
            print(catalog.import_yaml(f.read()))
    elif args.action == "export":
        with open(args.file, "w") as f:
            f.write(catalog.export_yaml())
    elif args.action == "search":
        for r in catalog.search("objects", args.embedding, args.prompt).collect():
            print(r["id"], r["schema_name"], r["name"], r["column_name"] or "", round(r["distance"], 4))
    elif args.action == "generate-sql":
        print(text2sql.generate_sql(catalog, args.embedding, text2sql.KeywordModel(), args.prompt).sql)
    else:
        for action, what in catalog.refresh(args.dry_run):
            print(action, what)
    return 0


if __name__ == "__main__":
    sys.exit(main())
