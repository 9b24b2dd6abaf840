"""Command line: python -m echolith STORE COMMAND ..."""

from __future__ import annotations

import argparse
import sys
import time

from echolith.engine import MODES, HistoryEngine
from echolith.runtime import build_session
from echolith.sources.exports import json_document
from echolith.sources.history_files import PARSERS, detect_shell


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="echolith")
    p.add_argument("store")
    p.add_argument("--packs", help="folder of own knowledge packs")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *positional: str, **options) -> None:
        c = sub.add_parser(name)
        for x in positional:
            c.add_argument(x, nargs="+" if x in ("query", "question", "text") else None)
        for option, default in options.items():
            flag = "--" + option.replace("_", "-")
            if default is False:
                c.add_argument(flag, action="store_true")
            else:
                c.add_argument(flag, default=default, type=type(default) if default is not None else str)

    add("ingest", "events", sessions=None)
    add("search", "query", limit=20, mode="hybrid", cwd=None, recent=False, json=False)
    add("semantic", "query", limit=10)
    add("recent", limit=20)
    add("stats")
    add("count")
    add("db")
    add("status")
    add("sources", "query", limit=20, mode="hybrid")
    add("validate")
    add("cleanup", "mode", days=365, most=1_000_000)
    add("optimize")
    add("export", "path", format="json", limit=100_000)
    add("import", shell=None, file=None, dry_run=False, preview=False)
    add("reindex", full=False)
    add("ask", "question", limit=5)
    add("explain", "text")
    add("learn", "topic")
    add("packs")
    return p


def run(engine: HistoryEngine, args: argparse.Namespace, now_ms: int):
    """What the command gives: a frame, a document or nothing."""
    words = " ".join(getattr(args, "query", None) or getattr(args, "question", None) or getattr(args, "text", None) or [])
    spark = engine.spark
    match args.command:
        case "ingest":
            return {"batch": engine.ingest(spark.read.parquet(args.events), spark.read.parquet(args.sessions) if args.sessions else None)}
        case "search":
            if args.mode not in MODES:
                raise SystemExit(f"no such mode: {args.mode}; there are {', '.join(MODES)}")
            return engine.search(words, args.limit, args.mode, cwd=args.cwd, recent_only=args.recent)
        case "semantic":
            return engine.semantic(words, args.limit)
        case "recent":
            return engine.recent(args.limit)
        case "stats":
            return engine.usage()
        case "count":
            return {"commands": engine.count()}
        case "db":
            return engine.counts().first().asDict() | engine.storage().first().asDict()
        case "status":
            return engine.index_status().first().asDict() | {"model": engine.provider.name, "dimensions": engine.provider.dimensions}
        case "sources":
            return engine.source_counts(words, args.limit, mode=args.mode)
        case "validate":
            errors = engine.packs().errors
            if errors:
                raise SystemExit("\n".join(map(str, errors)))
            return {"entries": engine.packs().entries.count(), "errors": 0}
        case "cleanup":
            removed, remaining = engine.cleanup(args.mode, now_ms, args.days, args.most)
            return {"removed": removed, "remaining": remaining}
        case "optimize":
            return engine.optimize()
        case "export":
            return engine.export(args.path, args.format, args.limit)
        case "import":
            shell, file = (args.shell, args.file) if args.file else detect_shell()
            if shell not in PARSERS:
                raise SystemExit(f"no such shell: {shell}; there are {', '.join(PARSERS)}")
            return engine.import_history(shell, file, now_ms, args.dry_run, args.preview)
        case "reindex":
            return {"embedded": engine.reindex(now_ms, args.full)}
        case "ask":
            return engine.ask(words, args.limit)
        case "explain":
            return engine.explain(words)
        case "learn":
            return engine.learn(args.topic)
        case "packs":
            for error in engine.packs().errors:
                print(error, file=sys.stderr)
            return engine.packs().packs


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    engine = HistoryEngine(build_session(), args.store, packs=args.packs)
    out = run(engine, args, int(time.time() * 1000))
    if out is None:
        return
    if isinstance(out, dict):
        print("\n".join(f"{k}: {v}" for k, v in out.items()))
    elif getattr(args, "json", False):
        print(json_document(out))
    else:
        out.show(200, truncate=False)


if __name__ == "__main__":
    main()
