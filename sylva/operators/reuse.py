"""Reuse between builds: carry-over by content hash, lockfile seeding, staleness, pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import described, in_subtree, without_stale
from ..schema import STALE


def carry_over(new: DataFrame, previous: DataFrame) -> DataFrame:
    """``new`` with description and vector of the previous row with the same uid and (non-empty) hash, where it has
    none itself, and ``carried``: whether such a row was found. Frames have uid, diff_hash, description, vector."""
    old = previous.where(F.col("diff_hash") != "").select("uid", "diff_hash", F.nullif(without_stale("description"), F.lit("")).alias("_description"), F.col("vector").alias("_vector"), F.lit(True).alias("_found")).dropDuplicates(["uid", "diff_hash"])
    joined = new.join(old, ["uid", "diff_hash"], "left")
    return joined.withColumn("description", F.coalesce("_description", F.nullif("description", F.lit("")))).withColumn("vector", F.coalesce("_vector", "vector")).withColumn("carried", F.coalesce("_found", F.lit(False))).drop("_description", "_vector", "_found")


def seed_from_lock(rows: DataFrame, lock: DataFrame) -> DataFrame:
    """Descriptions (and vectors) of the lockfile, by uid and hash, where a row has no description."""
    held = lock.select("uid", "diff_hash", F.nullif("description", F.lit("")).alias("_description"), F.col("vector").alias("_vector")).dropDuplicates(["uid", "diff_hash"])
    joined = rows.join(held, ["uid", "diff_hash"], "left")
    bare = F.coalesce(F.length("description"), F.lit(0)) == 0
    return joined.withColumn("vector", F.when(bare & F.col("_description").isNotNull(), F.coalesce("_vector", "vector")).otherwise(F.col("vector"))).withColumn("description", F.when(bare, F.col("_description")).otherwise(F.col("description"))).drop("_description", "_vector")


def mark_stale(rows: DataFrame) -> DataFrame:
    """Non-empty descriptions get the stale mark, once."""
    d = F.col("description")
    return rows.withColumn("description", F.when((d != "") & ~d.startswith(STALE), F.concat(F.lit(STALE), d)).otherwise(d))


def collect_descriptions(structs: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """``uid, diff_hash, description`` (and ``vector``) of structs that have a description that is not stale."""
    own = structs.where(described("description"))
    if vectors is None:
        return own.select("uid", "diff_hash", "description")
    return own.select("id", "uid", "diff_hash", "description").join(vectors, F.col("id") == F.col("struct_id"), "left").select("uid", "diff_hash", "description", "vector")


def removed(stored: DataFrame, kept: DataFrame, key: str = "id") -> DataFrame:
    """Stored rows that are not among the kept ones."""
    return stored.join(kept.select(key).distinct(), key, "left_anti")


def drop_nodes(structs: DataFrame, edges: DataFrame, vectors: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the doomed ids, edges gone in both directions."""
    gone = doomed.select(F.col("id").alias("gone")).distinct()
    return (
        structs.join(gone, F.col("id") == F.col("gone"), "left_anti"),
        edges.join(gone, F.col("source_id") == F.col("gone"), "left_anti").join(gone, F.col("target_id") == F.col("gone"), "left_anti"),
        vectors.join(gone, F.col("struct_id") == F.col("gone"), "left_anti"),
    )


def drop_subtree(structs: DataFrame, edges: DataFrame, vectors: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return drop_nodes(structs, edges, vectors, structs.where(in_subtree("path", path)))


def latest_changes(changes: DataFrame, key: str = "path", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The last change of each path."""
    columns = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("x")).select(key, "x.*")
