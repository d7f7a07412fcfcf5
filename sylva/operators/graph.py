"""Edges of the code graph: containment, roll-up of dependencies, fan-in and fan-out, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CHILD, DEPENDS, FUZZY
from ..scratch import Scratch

#: Levels of containment that the roll-up climbs at most; deeper trees raise.
MAX_DEPTH = 200


def containment(structs: DataFrame) -> DataFrame:
    """``is_child_of`` edges, child to parent; a struct is never its own parent."""
    return structs.where(F.col("parent_id").isNotNull() & (F.col("parent_id") != F.col("id"))).select(F.col("id").alias("source_id"), F.col("parent_id").alias("target_id"), F.lit(CHILD).alias("edge_type"))


def roll_up(leaf: DataFrame, parents: DataFrame) -> DataFrame:
    """Distinct ``(source, target)`` of ``leaf`` and of everything above it; ``parents`` is ``(id, parent_id)``.

    Both ends climb in lock-step, as long as both have parents and these differ. A round is two equi joins on the pairs
    of the round before, which are distinct; pairs that rounds have in common are made one at the end, all at once.
    """
    up = parents.where(F.col("parent_id").isNotNull() & (F.col("parent_id") != F.col("id"))).select("id", "parent_id")
    new = Scratch(leaf.select("source", "target").where("source <> target").distinct(), "edges").df
    known, rounds = new, 1
    for _ in range(MAX_DEPTH):
        step = new.join(up.select(F.col("id").alias("source"), F.col("parent_id").alias("s")), "source").join(up.select(F.col("id").alias("target"), F.col("parent_id").alias("t")), "target")
        new = Scratch(step.where("s <> t").select(F.col("s").alias("source"), F.col("t").alias("target")).distinct(), "edges").df
        if new.isEmpty():
            return known.distinct() if rounds > 1 else known
        known, rounds = known.unionByName(new), rounds + 1
    raise ValueError(f"containment is deeper than {MAX_DEPTH} levels")


def dependency_edges(exact: DataFrame, fuzzy: DataFrame, parents: DataFrame) -> DataFrame:
    """Rolled-up ``depends_on`` and ``depends_on_fuzzy`` edges of resolved ``(source, target)`` pairs."""
    out = [roll_up(pairs, parents).select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.lit(kind).alias("edge_type")) for pairs, kind in ((exact, DEPENDS), (fuzzy, FUZZY))]
    return out[0].unionByName(out[1])


def all_edges(structs: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Every edge once; structs have one row each, so only dependencies can repeat."""
    return dependencies.dropDuplicates(["source_id", "target_id", "edge_type"]).unionByName(containment(structs))


def with_endpoints(edges: DataFrame, structs: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    ids = structs.select("id")
    return edges.join(ids, F.col("source_id") == F.col("id"), "left_semi").join(ids, F.col("target_id") == F.col("id"), "left_semi")


def orphans(structs: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(kind, n)``: dangling edges and vectors without a struct; both are 0 in a sound store."""
    ids = structs.select("id")
    dangling = edges.select(F.explode(F.array("source_id", "target_id")).alias("end"), "source_id", "target_id", "edge_type").join(ids, F.col("end") == F.col("id"), "left_anti").select("source_id", "target_id", "edge_type").distinct()
    lost = vectors.join(ids, F.col("struct_id") == F.col("id"), "left_anti")
    return dangling.agg(F.count("*").alias("n")).select(F.lit("dangling_edges").alias("kind"), "n").unionByName(lost.agg(F.count("*").alias("n")).select(F.lit("orphan_vectors").alias("kind"), "n"))


def dependency_strings(edges: DataFrame, structs: DataFrame, of: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Per ``key`` the sorted ``id|uid`` lists of inbound and outbound dependencies, fuzzy ones marked ``~``; only for the
    structs ``of(key)``, if given. The key is ``id``, or ``uid``, which alone tells structs of one id apart.

    Edges that have ``source_uid`` and ``target_uid`` need no look at the structs, and only they can be told by uid."""
    kinds = edges.where(F.col("edge_type").isin(DEPENDS, FUZZY))
    outward = inward = kinds
    if of is not None:
        asked = of.select(F.col(key).alias("_of")).distinct()
        outward, inward = (kinds.join(asked, F.col(f"{end}_{key}") == F.col("_of"), "left_semi") for end in ("source", "target"))
    if "source_uid" not in edges.columns:
        uids = structs.select("id", "uid")
        outward = outward.join(uids.withColumnRenamed("uid", "target_uid"), F.col("target_id") == F.col("id"))
        inward = inward.join(uids.withColumnRenamed("uid", "source_uid"), F.col("source_id") == F.col("id"))
    mark = F.when(F.col("edge_type") == FUZZY, "~").otherwise("")
    said = lambda end: F.concat(mark, F.col(f"{end}_id"), F.lit("|"), F.col(f"{end}_uid"))
    out = outward.groupBy(F.col(f"source_{key}").alias("of")).agg(F.sort_array(F.collect_list(said("target"))).alias("outbound"))
    into = inward.groupBy(F.col(f"target_{key}").alias("of")).agg(F.sort_array(F.collect_list(said("source"))).alias("inbound"))
    return out.join(into, "of", "full").select(F.col("of").alias(key), F.coalesce("inbound", F.array().cast("array<string>")).alias("inbound"), F.coalesce("outbound", F.array().cast("array<string>")).alias("outbound"))


def fan(edges: DataFrame, structs: DataFrame) -> DataFrame:
    """Per struct ``fan_in, fan_out``, its children and child types, and ``impact_score`` (fan-in plus child types)."""
    deps = edges.where(F.col("edge_type").isin(DEPENDS, FUZZY))
    into = deps.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("fan_in"))
    out = deps.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("fan_out"))
    below = structs.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n_children"), F.countDistinct("type").alias("n_child_types"))
    joined = structs.select("id", "uid", "type").join(into, "id", "left").join(out, "id", "left").join(below, "id", "left").na.fill(0)
    return joined.withColumn("impact_score", F.col("fan_in") + F.col("n_child_types"))
