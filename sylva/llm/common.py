"""Shared pieces: table reading, bounded Arrow batches, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, early_cleanup, new_scratch, save

__all__ = ["WORD", "Scratch", "connected_components", "early_cleanup", "new_scratch", "save", "small_batches", "table", "whole_row"]

#: A run of characters other than space and the ASCII control white space: what every operator here calls a word.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch on its way to Python, unless the session sets its own: several are held at once.
BATCH_SETTING, BATCH_BYTES, USUAL_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m", ("67108864b", "64MB", "64m")


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker and its executor hold of long texts, unless the session has a setting already."""
    if spark.conf.get(BATCH_SETTING, USUAL_BYTES[0]) in USUAL_BYTES:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct, whatever their names hold (dots, back quotes)."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in df.columns]
    return F.struct(*[F.col(q).alias(c) for q, c in zip(quoted, df.columns)])


def connected_components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` links between longs -> ``(node, component)`` for every node that has a link, component being the
    smallest node reachable.

    Alternates large-star and small-star steps: a step is an aggregate with map-side minimum plus an equi join, so a
    hub costs no more than its links, and the link count never grows. Every step's links are written to scratch;
    the loop ends when a step changes nothing. Null ends and self links are ignored.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now = Scratch(links, "links")
    sign = _sign(now.df)
    while sign[0]:
        both = now.df.unionByName(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        step = Scratch(large, "links")
        low = step.df.groupBy("a").agg(F.min("b").alias("m"))
        small = step.df.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        after = Scratch(small.select("x.a", "x.b").where("a > b").distinct(), "links")
        now.drop()
        step.drop()
        now, before, sign = after, sign, _sign(after.df)
        if sign == before:
            break
    return now.df.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.df.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _sign(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
