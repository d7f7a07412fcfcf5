"""Descriptions, bottom-up by tree depth, with a pluggable describer; without one nothing is described.

A directory with no children is "Empty Directory", one with a single child repeats its text; neither has a vector. A file
with a blank body is "Empty File", without a vector; one with a single child that is no method takes that child's text
and vector. Everything else asks the describer, one level of the tree at a time: a directory by its children's
descriptions, a file by those of its classes and the bodies of its functions, a class by its skeleton (its text with what
is described put in brief) and the signatures of its methods. Methods are described along with the file or class they are
in: the describer answers with a text, or with ``{"description": text, "methods": {position: text}}``; after a text alone
it is asked for each method by itself. Fields are never described. Calls are repeated while the other end says busy, and
no more than ``CONCURRENT`` run at a time.
"""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CLASS, DIRECTORY, FIELD, FILE, METHOD
from ..scratch import save

Describer = Callable[[dict], "str | dict | None"]
ATTEMPTS, DELAY, BUSY = 3, 2.0, (429, 503)
CONCURRENT = 200
#: Levels of the tree at most; deeper ones raise.
MAX_DEPTH = 200
#: Beside a described struct: the id whose vector it takes, empty for none, null for one of its own.
VECTOR_OF = "vector_of"


def strategy(name: str | None, known: dict, **options):
    """The describer (or embedder) of that name, built with those of the options that it takes; None for "none".

    ``known`` maps names to factories; an unknown name raises ValueError.
    """
    if name in (None, "none"):
        return None
    if name not in known:
        raise ValueError(f"unknown strategy: {name}; known are {', '.join(sorted(known))}")
    takes = inspect.signature(known[name]).parameters
    every = any(p.kind is p.VAR_KEYWORD for p in takes.values())
    return known[name](**{k: v for k, v in options.items() if every or k in takes})


def needs_description(structs: DataFrame) -> DataFrame:
    """Ids of structs that have no description, or a child other than a field that has none."""
    bare = structs.where(F.coalesce(F.length("description"), F.lit(0)) == 0)
    above = bare.where((F.col("type") != FIELD) & F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("id"))
    return bare.select("id").unionByName(above).distinct()


def with_retries(call: Callable[[], str], attempts: int = ATTEMPTS, delay: float = DELAY, sleep=time.sleep) -> str | None:
    """The call's result; tried again, ever more slowly, only while its error's ``code`` says busy; else None."""
    for k in range(attempts):
        try:
            return call()
        except Exception as e:
            if getattr(e, "code", None) not in BUSY or k == attempts - 1:
                return None
            sleep(delay * 2**k)
    return None


def index_replies(replies: dict, n: int) -> dict[int, str]:
    """A batch's replies by position; keys that are no number of the batch are left out."""
    out = {}
    for k, v in replies.items():
        try:
            pos = int(k)
        except (TypeError, ValueError):
            continue
        if 0 <= pos < n:
            out[pos] = v
    return out


def depths(structs: DataFrame) -> DataFrame:
    """``(id, depth)`` from the topmost structs of the frame down; ValueError beyond MAX_DEPTH."""
    above = structs.select(F.col("id").alias("parent_id"))
    level = structs.join(above, "parent_id", "left_anti").select("id", F.lit(0).alias("depth"))
    out = level
    for k in range(1, MAX_DEPTH + 1):
        level = save(structs.join(level.select(F.col("id").alias("parent_id")), "parent_id").select("id", F.lit(k).alias("depth")), "depth")
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"the tree is deeper than {MAX_DEPTH} levels")


def skeletonize(body: str, offset: int, children: list[tuple[int, int, str, str, str]]) -> str:
    """A class's text with each described child ``(start, end, id, signature, description)`` put in brief; bounds are
    byte offsets in the file, spliced from the end."""
    data = body.encode()
    for start, end, ident, signature, description in sorted(children, reverse=True):
        if description:
            data = data[: start - offset] + f"{ident} | {signature}\n// {description}".encode() + data[end - offset :]
    return data.decode()


def spans_of(body: str, first_line: int, children: list[dict]) -> list[tuple[int, int, str, str, str]]:
    """What ``skeletonize`` takes, of children ``(id, body, signature, description, start_line)``: their text is looked
    for from the line on where they start."""
    data, lines = body.encode(), [0]
    for line in body.encode().splitlines(keepends=True):
        lines.append(lines[-1] + len(line))
    out = []
    for c in children:
        own = (c["body"] or "").encode()
        at = data.find(own, lines[max(0, min(c["start_line"] - first_line, len(lines) - 1))]) if own else -1
        if at >= 0:
            out.append((at, at + len(own), c["id"], c["signature"] or "", c["description"] or ""))
    return out


def request_of(row: dict) -> tuple[dict, list[dict]]:
    """What the describer is asked for a struct with its children, and the methods that wait for a description."""
    children = list(row["children"]) if row["children"] is not None else []
    asked = {"kind": row["type"], **{k: row[k] for k in ("uid", "name", "type", "path", "signature")}}
    waiting = [c for c in children if c["type"] == METHOD and not c["description"]]
    if row["type"] == CLASS:
        inner = [c for c in children if c["type"] in (CLASS, METHOD)]
        code = skeletonize(row["body"] or "", 0, spans_of(row["body"] or "", int(row["start_line"] or 1), inner))
        return asked | {"code": code, "methods": {str(k): c["signature"] for k, c in enumerate(waiting)}}, waiting
    described = {c["uid"]: c["description"] for c in children if c["description"]}
    if row["type"] == FILE and not children:
        return asked | {"content": row["body"]}, []
    if row["type"] == FILE:
        return asked | {"described": described, "methods": {str(k): c["body"] for k, c in enumerate(waiting)}}, waiting
    return asked | {"children": described}, []


def answers(row: dict, describer: Describer) -> list[tuple[str, str]]:
    """``(id, description)`` of a struct and of its methods; what gets no answer is left out."""
    asked, waiting = request_of(row)
    reply = with_retries(lambda: describer(asked))
    if not reply:
        return []
    if isinstance(reply, dict):
        by_place = index_replies(reply.get("methods") or {}, len(waiting))
        return [(row["id"], reply.get("description"))] + [(waiting[k]["id"], said) for k, said in sorted(by_place.items())]
    out = [(row["id"], reply)]
    for c in waiting:
        alone = {"kind": METHOD, "uid": c["uid"], "name": c["name"], "type": METHOD, "path": row["path"], "signature": c["signature"], "code": c["body"]}
        out.append((c["id"], with_retries(lambda: describer(alone))))
    return [(i, said) for i, said in out if isinstance(said, str)]


def describe(structs: DataFrame, describer: Describer | None) -> DataFrame:
    """``structs`` with descriptions where there were none, and whose vector each takes (VECTOR_OF): with a describer,
    what is left without a description has none."""
    if describer is None:
        return structs.withColumn(VECTOR_OF, F.lit(None).cast("string"))

    def work(frames):
        for f in frames:
            said = [x for r in f.to_dict("records") for x in answers(r, describer)]
            yield pd.DataFrame(said, columns=["id", "said"])

    rows = save(structs.join(depths(structs), "id", "left"), "to-describe")
    known = rows.select("id", "description", F.lit(None).cast("string").alias(VECTOR_OF))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    bare = F.coalesce(F.length("description"), F.lit(0)) == 0
    for k in range(deepest, -1, -1):
        level = rows.where((F.col("depth") == k) & F.col("type").isin(DIRECTORY, FILE, CLASS)).drop("description").join(known.select("id", "description"), "id").where(bare)
        below = rows.where((F.col("depth") == k + 1) & F.col("parent_id").isNotNull()).drop("description").join(known.select("id", "description"), "id")
        inner = F.when(F.col("type").isin(CLASS, METHOD), F.col("body"))
        sums = below.groupBy(F.col("parent_id").alias("id")).agg(
            F.count("*").alias("n"), F.min("type").alias("only_type"), F.min("description").alias("only_text"), F.min("id").alias("only_id"),
            F.array_sort(F.collect_list(F.struct("start_line", "uid", "id", "name", "type", "description", "signature", inner.alias("body")))).alias("children"),
        )
        level = level.join(sums.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").drop("_id")
        copied = F.when((F.col("type") == DIRECTORY) & F.col("n").isNull(), "Empty Directory").when((F.col("type") == DIRECTORY) & (F.col("n") == 1), F.col("only_text"))
        copied = copied.when((F.col("type") == FILE) & F.col("n").isNull() & (F.trim(F.coalesce("body", F.lit(""))) == ""), "Empty File").when((F.col("type") == FILE) & (F.col("n") == 1) & (F.col("only_type") != METHOD), F.col("only_text"))
        alone = (F.col("type") == FILE) & (F.col("n") == 1) & (F.col("only_type") != METHOD)
        settled = F.coalesce((F.col("type") == DIRECTORY) & (F.coalesce("n", F.lit(0)) < 2) | alone, F.lit(False)) | copied.isNotNull()
        level = save(level.withColumn("copied", copied).withColumn("settled", settled).withColumn(VECTOR_OF, F.when(alone, F.col("only_id")).otherwise("")), "level")
        asked = level.where("not settled").select("id", "uid", "name", "type", "path", "signature", "body", "start_line", "children")
        calls = asked.count()
        said = asked.repartition(max(1, min(CONCURRENT, calls))).mapInPandas(work, "id string, said string").withColumn("of", F.lit(None).cast("string"))
        said = said.unionByName(level.where("settled").select("id", F.col("copied").alias("said"), F.col(VECTOR_OF).alias("of")))
        said = said.groupBy("id").agg(F.max("said").alias("said"), F.max("of").alias("of"))
        known = save(known.join(said, "id", "left").select("id", F.coalesce("said", "description").alias("description"), F.coalesce("of", VECTOR_OF).alias(VECTOR_OF)), "described")
    known = known.withColumn(VECTOR_OF, F.when(F.coalesce(F.length("description"), F.lit(0)) == 0, "").otherwise(F.col(VECTOR_OF)))
    return structs.drop("description").join(known, "id").select(*structs.columns, VECTOR_OF)
