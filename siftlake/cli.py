"""The command line: python -m siftlake.cli --store FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import json
import os
import sys

from siftlake.functions.analysis import analyzed_words
from siftlake.operators import filters
from siftlake.sources import schemas

# fixed values: what is read where nothing is set
DEFAULTS = {"limit": 10, "rrf_k": 60, "language": "en", "chunk": {"max": 1000, "overlap": 100}, "embedding": {"dimension": 64, "batch": 6}, "service": {"interval": 3600, "least": 60}}
TYPES = ("markdown", "code", "image", "pdf", "document", "parser")


def config(path: str | None) -> dict:
    """Defaults, overlaid by a YAML file in which $NAME and ${NAME} stand for environment variables."""
    import yaml

    given = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            given = yaml.safe_load(os.path.expandvars(f.read())) or {}
    return DEFAULTS | {k: DEFAULTS[k] | v if isinstance(v, dict) and isinstance(DEFAULTS.get(k), dict) else v for k, v in given.items()}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftlake")
    p.add_argument("--store", default="siftlake-store")
    p.add_argument("--config")
    p.add_argument("--schemas", help="folder of own parser schemas")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("add", help="create a collection and sync it")
    a.add_argument("name")
    a.add_argument("path", nargs="?", default="")
    a.add_argument("--type", choices=TYPES, default="markdown")
    a.add_argument("--pattern", default="")
    a.add_argument("--parser")
    for name in ("rm", "sync"):
        c = sub.add_parser(name)
        c.add_argument("name", nargs="?" if name == "sync" else None)
    sub.add_parser("status")
    e = sub.add_parser("embed")
    e.add_argument("--force", action="store_true")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--mode", choices=("hybrid", "lexical", "vector"), default="hybrid")
    s.add_argument("--query-mode", choices=("structured", "raw"), default="structured")
    s.add_argument("--limit", type=int, default=0)
    for flag in ("collection", "type", "lang", "workspace", "after", "before", "path", "chunk-type", "sort-by"):
        s.add_argument(f"--{flag}")
    s.add_argument("--repo", dest="collection_alias")
    s.add_argument("--desc", action="store_true")
    s.add_argument("-C", "--context", type=int, default=0)
    s.add_argument("--facet", action="append", default=[])
    s.add_argument("--json", action="store_true")
    t = sub.add_parser("analyze")
    t.add_argument("text")
    t.add_argument("--language", default="en")
    c = sub.add_parser("complete")
    c.add_argument("prefix")
    c.add_argument("--most", type=int, default=10)
    sub.add_parser("schema")
    sub.add_parser("parsers")
    sub.add_parser("config")
    v = sub.add_parser("service", help="sync all collections again and again")
    v.add_argument("--interval", type=int)
    v.add_argument("--once", action="store_true")
    return p


def filters_of(args) -> filters.FilterSet:
    fields = tuple((n, v) for n, v in (("lang", args.lang), ("workspace", args.workspace)) if v)
    return filters.FilterSet(args.collection or args.collection_alias, args.type, args.after, args.before, args.path, args.chunk_type, fields)


def main(argv: list[str] | None = None, spark=None, out=sys.stdout) -> int:
    args = parser().parse_args(argv)
    settings = config(args.config)
    say = lambda *x: print(*x, file=out)
    if args.command == "analyze":
        say(" ".join(analyzed_words(args.text, args.language)))
        return 0
    if args.command == "schema":
        say(json.dumps(filters.FIELD_TYPES, indent=1))
        return 0
    if args.command == "parsers":
        for name in schemas.listed(args.schemas):
            found = schemas.detect(schemas.load(name, args.schemas))
            say(f"{name}\t{'version %d' % found[1].version if found else '-'}")
        return 0
    if args.command == "config":
        say(json.dumps(settings, indent=1))
        return 0
    from siftlake.engine import Engine
    from siftlake.operators.embed import hashing_embedder
    from siftlake.plans.session import build_session

    engine = Engine(spark or build_session(), args.store, hashing_embedder(settings["embedding"]["dimension"]), args.schemas)
    match args.command:
        case "add":
            say(json.dumps(engine.add(args.name, "parser" if args.parser else args.type, args.path, args.pattern, args.parser)))
        case "rm":
            engine.remove(args.name)
        case "sync" | "service":
            import time

            while True:
                failed = 0
                names = [args.name] if getattr(args, "name", None) else [r.name for r in engine.store.collections().collect()]
                for name in names:
                    try:
                        say(name, json.dumps(engine.sync(name)))
                    except (OSError, KeyError, schemas.SchemaError) as e:
                        failed = 1
                        say(name, f"failed: {e}")
                if args.command == "sync" or args.once:
                    return failed
                engine.embed()
                time.sleep(max(args.interval or settings["service"]["interval"], settings["service"]["least"]))
        case "status":
            for r in engine.status().collect():
                say(f"{r.name}\t{r.n_docs} documents\t{r.n_chunks} chunks")
        case "embed":
            engine.embed(args.force)
        case "complete":
            for r in engine.complete(args.prefix, args.most).collect():
                say(r.term)
        case "search":
            found = engine.search(args.query, args.mode, args.limit or settings["limit"], filters_of(args), args.query_mode, settings["language"], args.sort_by, args.desc, args.context)
            for i, r in enumerate(found.collect(), 1):
                say(json.dumps({"path": r.path, "title": r.title, "score": round(r.score, 6), "location": r.location}) if args.json else f"{i}. {r.title} ({r.score:.4f})\n   {r.location}\n   {r.line or ''}")
            for spec, rows in engine.facets(args.facet).items():
                say(spec, json.dumps([[b.key, b["count"]] for b in rows.collect()]))
    return 0


if __name__ == "__main__":
    sys.exit(main())
