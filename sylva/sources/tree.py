"""Source trees: a pruned walk and a Python data source that reads files in parallel.

Spark's own file sources skip names that begin with ``_`` or ``.``, so ``__init__.py`` would go missing; this source
lists what the ignore rules let through and hands out chunks of paths, each read by one task.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..parsers import html_source, java_source, python_source
from ..parsers.rows import directory_row, file_row
from ..schema import PARSED
from .ignore import IgnoreRules

# What each extension is read as.
LANGUAGES = {".py": "python", ".java": "java", ".html": "html", ".htm": "html"}
PARSERS = {"python": python_source.parse, "java": java_source.parse, "html": html_source.parse}
CHUNK = 64


def language_of(path: str) -> str | None:
    return LANGUAGES.get(os.path.splitext(path)[1].lower())


def relative(root: str, path: str) -> str:
    """A path as it is below the root: an absolute one with links followed, else as it is written, else by way of the
    directories above."""
    if not os.path.isabs(path):
        return os.path.normpath(path).replace(os.sep, "/")
    tries = (os.path.realpath(root), os.path.realpath(path)), (os.path.abspath(root), os.path.abspath(path))
    for base, full in tries:
        if full == base or full.startswith(base.rstrip(os.sep) + os.sep):
            return os.path.relpath(full, base).replace(os.sep, "/")
    return os.path.relpath(os.path.realpath(path), os.path.realpath(root)).replace(os.sep, "/")


def walk(root: str, rules: IgnoreRules, language: str | None = None, below: str = "."):
    """Yields ``(relative path, is directory)`` from ``below`` on, in order; ignored directories are not entered."""
    top = os.path.join(root, below)
    if os.path.isfile(top):
        if not rules.matches(below) and language_of(below) and language in (None, "auto", language_of(below)):
            yield below, False
        return
    if below != "." and rules.matches(below, True):
        return
    yield below, True
    for name in sorted(os.listdir(top)):
        path = name if below == "." else f"{below}/{name}"
        full = os.path.join(root, path)
        if os.path.isdir(full):
            if not os.path.islink(full):
                yield from walk(root, rules, language, path)
        elif not rules.matches(path) and language_of(path) and language in (None, "auto", language_of(path)):
            yield path, False


def parse_bytes(path: str, body: bytes) -> list[dict]:
    """Rows of one file. A body that is no UTF-8 gives a file row with ``error`` and the text decoded leniently."""
    try:
        return PARSERS[language_of(path)](path, body)
    except UnicodeDecodeError as e:
        return [file_row(path, body.decode("utf-8", errors="replace"), body, error=str(e))]


def as_tuple(row: dict) -> tuple:
    return tuple(row.get(f.name) for f in PARSED)


class _Chunk(InputPartition):
    def __init__(self, paths):
        super().__init__(paths)
        self.paths = paths


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.below = options["path"], options.get("below", ".")
        self.language, self.name = options.get("language"), options.get("name") or os.path.basename(os.path.abspath(options["path"]))

    def partitions(self):
        found = list(walk(self.root, IgnoreRules.load(self.root, self.language), self.language, self.below))
        return [_Chunk(found[k : k + CHUNK]) for k in range(0, len(found), CHUNK)] or [_Chunk([])]

    def read(self, partition):
        for path, is_dir in partition.paths:
            if is_dir:
                yield as_tuple(directory_row(path, self.name if path == "." else path.rpartition("/")[2]))
                continue
            with open(os.path.join(self.root, path), "rb") as f:
                body = f.read()
            for row in parse_bytes(path, body):
                yield as_tuple(row)


class SourceTree(DataSource):
    """``spark.read.format("source_tree").load(root)``: parsed rows of a tree; options language, below, name."""

    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return PARSED

    def reader(self, schema):
        return _TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, language: str | None = None, below: str = ".") -> DataFrame:
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").option("below", below)
    return (reader.option("language", language) if language else reader).load(root)


def parse_sources(sources: DataFrame) -> DataFrame:
    """Parsed rows of ``(path, body binary)`` rows, in Arrow batches; unsupported extensions give nothing.

    The sources are dealt out first: parsing takes far longer than moving them, and a small table, or one of few row
    groups, may hold a lot of files in one partition."""
    import pandas as pd

    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def work(frames):
        for f in frames:
            rows = [r for path, body in zip(f["path"], f["body"]) if language_of(path) for r in parse_bytes(path, bytes(body))]
            yield pd.DataFrame([as_tuple(r) for r in rows], columns=PARSED.fieldNames())

    return sources.select("path", "body").repartition(tasks, "path").mapInPandas(work, PARSED)


def ancestors(paths: list[str], name: str) -> list[dict]:
    """Directory rows of everything above the paths, up to the root."""
    dirs = {"."}
    for p in paths:
        parts = p.split("/")[:-1]
        dirs |= {"/".join(parts[:k]) for k in range(1, len(parts) + 1)}
    return [directory_row(d, name if d == "." else d.rpartition("/")[2]) for d in sorted(dirs)]
