"""``python -m sylva COMMAND PATH``: the engine from a shell."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from .plans.project import Project
from .store import StoreError


def session():
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("sylva").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = (builder if "SPARK_MASTER" in os.environ or "MASTER" in os.environ else builder.master("local[*]").config("spark.sql.shuffle.partitions", str(os.cpu_count()))).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sylva", description="Code-graph analytics on Spark.")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name, text, *arguments):
        c = commands.add_parser(name, help=text)
        c.add_argument("path", nargs="?", default=".", help="the project's root")
        for flags, options in arguments:
            c.add_argument(*flags, **options)

    lines = (("--max-lines",), {"type": int, "default": 500})
    language = (("--language",), {"choices": ["auto", "python", "java", "html"]})
    add("init", "write a configuration and an ignore file", (("--force",), {"action": "store_true"}))
    add("parse", "build the graph", (("--no-cache",), {"action": "store_true"}), (("--no-llm",), {"action": "store_true"}), (("--llm",), {}), language)
    add("status", "count what the store holds")
    add("skeleton", "show the tree", (("--subpath",), {"default": "."}), (("--depth",), {"type": int, "default": 4}), (("--files-only",), {"action": "store_true"}), lines)
    add("search", "find structs by meaning", (("--query",), {"required": True}), (("--filter",), {}), (("--top-k",), {"type": int, "default": 5}))
    add("inspect", "show structs by id or uid", (("--ids",), {"required": True}), (("--include-body",), {"action": "store_true"}), lines)
    add("export", "write the lockfile", (("--with-vectors",), {"action": "store_true"}))
    add("watch", "keep the store current", language)
    add("clean", "delete the store")
    top.add_argument("--verbose", action="store_true", help="say on standard error what goes on")
    return top


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    if a.verbose:
        logging.basicConfig(stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
        logging.getLogger("sylva").setLevel(logging.INFO)
    project = Project(spark or session(), a.path, language=getattr(a, "language", None))
    try:
        if a.command == "init":
            print("\n".join(project.init(a.force)) or "nothing to write")
        elif a.command == "parse":
            counts = project.parse(use_cache=not a.no_cache, no_llm=a.no_llm, llm=a.llm)
            print(f"{counts['structs']} structs, {counts['carried']} carried over, {counts['seconds']:.1f} s")
        elif a.command == "status":
            for r in project.status().orderBy("kind", "name").collect():
                print(f"{r['kind']:<10} {r['name']:<10} {r['n']}")
        elif a.command == "skeleton":
            print(project.render_skeleton(a.subpath, a.depth, a.files_only, a.max_lines))
        elif a.command == "search":
            print(project.render_search(a.query, a.filter, a.top_k))
        elif a.command == "inspect":
            print(project.render_inspect(a.ids, a.include_body, a.max_lines))
        elif a.command == "export":
            print("written" if project.export_lockfile(with_vectors=a.with_vectors) else "unchanged")
        elif a.command == "watch":
            project.watch().awaitTermination()
        else:
            print("deleted" if project.clean() else "nothing there")
    except (StoreError, FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
