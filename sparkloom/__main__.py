"""The command line: python -m sparkloom COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from .config import load_settings
from .plans.facade import Memory
from .plans.store import as_json, status_counts


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkloom", description="Documents in, answers out.")
    p.add_argument("--config", help="a settings file; else sparkloom.toml here or in ~/.sparkloom")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, filters: bool = True) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=about)
        for f in ("collection", "project", "layer") if filters else ():
            c.add_argument(f"--{f}")
        return c

    add = command("add", "add files, folders and URLs")
    add.add_argument("sources", nargs="+")
    add.add_argument("--tags")
    add.add_argument("--force", action="store_true", help="also what is known already")
    for name, about in (("search", "the best chunks"), ("ask", "an answer from the best chunks")):
        c = command(name, about)
        c.add_argument("question")
        c.add_argument("--top-k", type=int, default=0)
    command("chat", "questions from standard input, a line each", False)
    command("list", "the documents, newest first")
    command("stats", "what the store holds", False)
    command("config", "the settings in force", False)
    forget = command("forget", "delete a document by its exact path", False)
    forget.add_argument("path")
    follow = command("watch", "add what appears in a folder", False)
    follow.add_argument("folder")
    follow.add_argument("--checkpoint", required=True)
    follow.add_argument("--once", action="store_true", help="end when all that is there is added")
    return p


def main(args: list[str] | None = None, spark=None) -> int:
    """Runs a command and prints its result as JSON; 1 if nothing was found or added."""
    a = _parser().parse_args(args)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("sparkloom").getOrCreate()
    m = Memory(spark, load_settings(*([a.config] if a.config else [])))
    given = {k: v for k in ("collection", "project", "layer") if (v := getattr(a, k, None))}
    rows = lambda df: [r.asDict() for r in df.collect()]
    if a.command == "add":
        done = m.add(*a.sources, force=a.force, tags=a.tags, **given)
        counts = {r.status: r.n for r in status_counts(done).collect()}
        print(as_json({"results": rows(done), "counts": counts}))
        return int(not counts.get("ok") and not counts.get("skipped"))
    if a.command == "chat":
        say = m.chat()
        for line in sys.stdin:
            if line.strip():
                print(say(line.strip()))
        return 0
    if a.command == "watch":
        from .streaming.watch import watch

        watch(spark, a.folder, a.checkpoint, lambda df: m.add_frame(df, force=True), available_now=a.once).awaitTermination()
        return 0
    out = {
        "search": lambda: rows(m.search(a.question, a.top_k, **given)), "ask": lambda: m.ask(a.question, a.top_k, **given), "list": lambda: rows(m.list(**given)),
        "stats": m.stats, "config": m.config, "forget": lambda: m.forget(a.path, fuzzy=False),
    }[a.command]()
    print(as_json(out))
    return int(not out)


if __name__ == "__main__":
    sys.exit(main())
