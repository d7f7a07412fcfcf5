"""Mixing sources to target weights by systematic sampling.

All documents of a source expect the same number of copies (target words over source words). Documents are laid out
by ``(source, size, id)`` in range partitions, so a hot source is spread over many tasks; a document's place in its
source is its place in the partition plus the counts of the partitions before, which one row per partition and source
carries. A document is emitted once for each integer that the running sum of expected copies, started at a random
offset, crosses with it. Sorting by size makes neighbours alike, so taken words stay within about one document of the
target. Sums run in integers (``FRACTION`` bits), so reruns agree whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, whole_row

WEIGHTS = (3, 1, 2)
SHARE, CAP, SEED = 1.5, 2, "mix"
FRACTION = 24
ROW_BITS = 33


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``(source, source_size)`` -> the same with ``target`` and the source's ``offset``.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all words; a target stops at
    ``cap`` times its source's size, the excess going to the others by weight. With sources in the order of size over
    weight, the capped ones come first, so running sums give the water level. One row per source, so one small task.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_fill = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    sized = sizes.withColumn("place", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    )
    level = (
        sized.withColumn("sum_size", F.sum("source_size").over(everything))
        .withColumn("left_words", share * F.col("sum_size") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("capped", F.col("left_words") * F.col("weight") >= cap * F.col("source_size") * F.col("left_weight"))
    )
    first_open = F.min(F.when(~F.col("capped"), F.struct((F.col("source_size") / F.col("weight")).alias("fill"), "place", (F.col("left_words") / F.col("left_weight")).alias("water")))).over(everything)
    return level.withColumn("open", first_open).select(
        *sizes.columns,
        F.when(F.col("capped"), F.lit(float(cap)) * F.col("source_size")).otherwise(F.col("weight") * F.col("open").getField("water")).alias("target"),
        F.shiftright(F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("long"), 32 - FRACTION).alias("offset"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """Every row of docs as a struct ``row``, with ``size, source_size, target, copies`` (0 or more) beside it.

    A null text has size 0; a null source is a source of its own, last in order. Rows that tie on source, size and id
    are alike to the sampler and each counted. Sources without words have target 0 and no copies. An empty table gives
    an empty result.
    """
    return _mix(docs.select(whole_row(docs).alias("row"), *_key(text_col, source_col, id_col)), **how)


def allot(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """As ``mix``, but only ``doc_id, size, source_size, target, copies``: no text is moved."""
    return _mix(docs.select(F.col(id_col).alias("row"), *_key(text_col, source_col, id_col)), **how).withColumnRenamed("row", "doc_id")


def _key(text_col: str, source_col: str, id_col: str):
    key = F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"))
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key"), F.col(id_col).alias("id")


def _mix(base: DataFrame, **how) -> DataFrame:
    laid = base.repartitionByRange("key", "size", "id").sortWithinPartitions("key", "size", "id")
    at = F.monotonically_increasing_id()
    written = Scratch(laid.withColumn("part", F.shiftright(at, ROW_BITS)).withColumn("place", at.bitwiseAND((1 << ROW_BITS) - 1)), "mix").df
    parts = written.groupBy("key", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.sum("size").alias("words"))
    parts = Scratch(parts, "mix-parts").df
    named = parts.groupBy("key").agg(F.sum("words").alias("source_size")).select("key", F.when(~F.col("key.none"), F.col("key.name")).alias("source"), "source_size")
    plan = targets(named, **how).select("key", "source_size", "target", "offset")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("key", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")).join(plan, "key")
    rate = F.coalesce(F.round(F.try_divide(F.col("target"), F.col("source_size")) * (1 << FRACTION)).cast("long"), F.lit(0))
    place = F.col("place") + F.col("shift")
    crossed = F.shiftright(F.col("offset") + rate * (place + 1), FRACTION) - F.shiftright(F.col("offset") + rate * place, FRACTION)
    return written.join(starts, ["key", "part"]).select("row", "size", "source_size", "target", crossed.cast("int").alias("copies"))


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixture itself: each row of docs as many times as its running sum crosses an integer, same columns.

    Only ids, hashes and sizes are laid out by size, where long texts would gather in a few partitions; the copies then
    join the texts on id, hash and source, which spreads the texts evenly. Rows that agree in all three share their
    copies, in the order of a hash of all their columns.
    """
    size, key, ident = _key(text_col, source_col, id_col)
    who = F.struct(ident, F.xxhash64(text_col).alias("hash"), key)
    allotted = _mix(docs.select(who.alias("row"), size, key, ident), **how)
    shares = Scratch(allotted.groupBy("row").agg(F.sum("copies").alias("total"), F.count("*").alias("k")), "shares").df
    shares = shares.select(F.col("row.id").alias("_id"), F.col("row.hash").alias("_hash"), F.col("row.key").alias("_key"), "total", "k")
    texts = docs.select(whole_row(docs).alias("row"), ident, F.xxhash64(text_col).alias("hash"), key)
    match = F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")) & (F.col("key") == F.col("_key"))
    chosen = texts.join(shares.where("total > 0").hint("shuffle_hash"), match)
    single = chosen.where("k = 1").select("row", "total")
    if not shares.where("k > 1").isEmpty():
        hashed = [F.col("row").getField(c) for c, kind in docs.dtypes if "map<" not in kind]
        turn = F.row_number().over(Window.partitionBy("id", "hash", "key").orderBy(F.xxhash64(*hashed)))
        several = chosen.where("k > 1").withColumn("turn", turn)
        single = single.unionByName(several.select("row", (F.expr("total div k") + (F.col("turn") <= F.col("total") % F.col("k")).cast("long")).alias("total")))
    return single.where("total > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("total").cast("int")))).select("row.*")
