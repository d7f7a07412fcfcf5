"""Tree queries over ``(id, uid, name, type, parent_id)`` rows: subtrees, skeletons, inspection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import in_subtree, is_id
from ..schema import CLASS, DIRECTORY, FIELD, FILE, METHOD
from ..scratch import Scratch
from . import graph

# The order in which kinds of children are shown.
SHOW_ORDER = {"file": 0, "directory": 1, "class": 2, "method": 3}


def subtree(structs: DataFrame, path: str) -> DataFrame:
    return structs.where(in_subtree("path", path))


def skeleton(structs: DataFrame, root_id: str | None = None, depth: int = 4, files_only: bool = False, roots: DataFrame | None = None) -> DataFrame:
    """``id, uid, type, parent_id, depth, sort_path`` of a root and what shows below it.

    While levels are left, files, directories and (unless ``files_only``) classes open; methods show only directly
    under a file, and fields never. ``sort_path`` orders rows as the tree reads: by kind, then uid.
    """
    rank = F.lit(9)
    for kind, place in SHOW_ORDER.items():
        rank = F.when(F.col("type") == kind, place).otherwise(rank)
    kinds = [FILE, DIRECTORY] if files_only else [FILE, DIRECTORY, CLASS, METHOD]
    slim = structs.where(F.col("type").isin(*kinds)).select("id", "uid", "type", "parent_id", F.concat(rank.cast("string"), F.lit(":"), F.col("uid")).alias("key"))
    slim = Scratch(slim, "skeleton").df
    first = roots if roots is not None else structs.where(F.col("id") == root_id)
    level = first.select("id", "uid", "type", "parent_id", F.lit(0).alias("depth"), F.array(F.lit("")).alias("sort_path"))
    out = level
    for k in range(1, depth + 1):
        above = level.where(F.col("type") != METHOD).select(F.col("id").alias("above"), F.col("type").alias("above_type"), F.col("sort_path").alias("above_path"))
        level = slim.join(above, (F.col("parent_id") == F.col("above")) & (F.col("id") != F.col("above"))).where((F.col("type") != METHOD) | (F.col("above_type") == FILE))
        level = level.select("id", "uid", "type", "parent_id", F.lit(k).alias("depth"), F.concat("above_path", F.array("key")).alias("sort_path"))
        # Written, so that no level works out those above it again; the last one has none below.
        level = Scratch(level, "level").df if k < depth else level
        out = out.unionByName(level)
    return out


def render_skeleton(rows: DataFrame, max_lines: int = 500) -> str:
    """The indented text of a skeleton, cut at ``max_lines`` with a notice."""
    shown = rows.orderBy("sort_path").select(F.concat(F.expr("repeat('    ', depth)"), F.col("id"), F.lit("|"), F.col("uid")).alias("line")).limit(max_lines + 1).collect()
    return cut([r["line"] for r in shown], max_lines)


def cut(lines: list[str], max_lines: int) -> str:
    return "\n".join(lines if len(lines) <= max_lines else [*lines[:max_lines], f"... (output cut at {max_lines} lines)"])


def resolve_references(references: list[str], structs: DataFrame) -> DataFrame:
    """``(pos, ref, id, uid)`` of ids and uids in the order given; id and uid are null for what is not there."""
    spark = structs.sparkSession
    asked = spark.createDataFrame(list(enumerate(references)), "pos int, ref string")
    by_id = asked.where(is_id("ref")).join(structs.select("id", "uid"), F.col("ref") == F.col("id"), "left")
    by_uid = asked.where(~is_id("ref")).join(structs.select("id", "uid"), F.col("ref") == F.col("uid"), "left")
    return by_id.unionByName(by_uid)


def inspect(structs: DataFrame, edges: DataFrame, references: list[str], include_body: bool = False) -> DataFrame:
    """The asked structs and two levels below, flat: ``pos, ref, depth, id, uid, type, path, signature, description,
    body, start_line, end_line, inbound, outbound, parent_id, error``.

    Children of children show for files, directories and classes alone; bodies only for the asked structs and on
    request. What is not found gives one row with ``error``. Dependencies are gathered of the structs shown only, by uid
    where the edges have ``source_uid`` and ``target_uid``. Children are told by their parents' ids and, if the structs
    have ``parent_uid``, uids.
    """
    found = resolve_references(references, structs)
    full = structs.select("id", "uid", "type", "path", "signature", "description", "body", "start_line", "end_line", "parent_id")
    top = found.join(full, ["id", "uid"], "left").withColumn("depth", F.lit(0)).withColumn("error", F.when(F.col("uid").isNull(), F.concat(F.lit("not found: "), F.col("ref"))))
    slim = (structs if "parent_uid" in structs.columns else structs.withColumn("parent_uid", F.lit(None).cast("string"))).select(*full.columns, "parent_uid")
    slim = slim.withColumn("body", F.lit(None).cast("string"))
    known = F.coalesce(F.col("parent_uid") == F.col("above_uid"), F.lit(True))
    levels, above = [top if include_body else top.withColumn("body", F.lit(None).cast("string"))], top
    for depth in (1, 2):
        opened = above.where(~F.col("type").isin(FIELD, METHOD)).select("pos", "ref", F.col("id").alias("above"), F.col("uid").alias("above_uid"))
        above = slim.join(opened, (F.col("parent_id") == F.col("above")) & known).drop("above", "above_uid", "parent_uid").withColumn("depth", F.lit(depth)).withColumn("error", F.lit(None).cast("string"))
        levels.append(above.select(*levels[0].columns))
    out = Scratch(levels[0].unionByName(levels[1]).unionByName(levels[2]), "inspected").df
    key = "uid" if "source_uid" in edges.columns else "id"
    return out.join(graph.dependency_strings(edges, structs, out.where("id is not null"), key), key, "left")


def single_child(structs: DataFrame) -> DataFrame:
    """Parents that have exactly one child, with it: ``(parent_id, id)``."""
    return structs.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("parent_id", "id")
