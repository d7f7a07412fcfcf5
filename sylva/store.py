"""The store: three Parquet tables in buckets by path, and a pointer that says where each bucket lies.

Rows belong to the bucket of their struct's path (an edge to that of its source), so what one file defines lies together.
A write puts new buckets into a directory of its own and then flips the pointer, so readers see the old graph or the new
one, never a mixture; buckets that it does not touch stay where they are. Structs are partitioned by type within a
bucket, so type filters prune directories. There is one writer at a time: a write that was prepared on a graph which
another has replaced meanwhile is refused.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import EDGES, STORE_VERSION, STRUCTS, VECTORS

#: Structs for each bucket, and buckets at least.
BUCKET_ROWS, LEAST_BUCKETS = 50_000, 8


class StoreError(Exception):
    """There is no store, or one of another format version."""


class StoreConflict(StoreError):
    """The graph that a write was prepared on is no longer the current one."""


def bucket_of(path: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(path) if isinstance(path, str) else path, F.lit(""))), F.lit(buckets)).cast("int")


class Store:
    TABLES = {"structs": STRUCTS, "edges": EDGES, "vectors": VECTORS}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def _meta(self) -> dict | None:
        fs, path = self._fs(f"{self.root}/_meta.json")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def exists(self) -> bool:
        return self._meta() is not None

    def is_compatible(self) -> bool:
        meta = self._meta()
        return meta is not None and meta.get("format") == STORE_VERSION

    def require(self) -> dict:
        meta = self._meta()
        if meta is None:
            raise StoreError(f"nothing has been parsed into {self.root}")
        if meta.get("format") != STORE_VERSION:
            raise StoreError(f"{self.root} has format {meta.get('format')}, not {STORE_VERSION}")
        return meta

    # -- reading

    def read(self, name: str, buckets=None, meta: dict | None = None) -> DataFrame:
        """A table as it is now (or as of ``meta``), whole or some buckets of it."""
        places = (meta or self.require())["tables"][name]
        wanted = places if buckets is None else {str(k): places[str(k)] for k in buckets if str(k) in places}
        columns = self.TABLES[name].fieldNames()
        if not wanted:
            return self.spark.createDataFrame([], self.TABLES[name])
        return self._files(name, wanted).select(*columns)

    def _files(self, name: str, places: dict) -> DataFrame:
        paths = [f"{self.root}/{name}/version={v}/bucket={k}" for k, v in sorted(places.items())]
        return self.spark.read.schema(self.TABLES[name]).option("basePath", f"{self.root}/{name}").parquet(*paths)

    def tables(self, buckets=None, meta: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        meta = meta or self.require()
        return tuple(self.read(name, buckets, meta) for name in self.TABLES)

    def buckets_with_edges_to(self, ids: DataFrame, meta: dict) -> set[int]:
        """The buckets that hold an edge into one of ``ids(id)``: only targets are read."""
        places = meta["tables"]["edges"]
        if not places:
            return set()
        edges = self._files("edges", places).select("target_id", "bucket")
        return {r["bucket"] for r in edges.join(ids, F.col("target_id") == F.col("id"), "left_semi").select("bucket").distinct().collect()}

    def size(self) -> int:
        """Bytes of the current buckets' files and all else below the root."""
        fs, path = self._fs(self.root)
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0

    # -- writing

    def write(self, structs: DataFrame, edges: DataFrame, vectors: DataFrame, touched=None, base: dict | None = None, applied: dict | None = None) -> None:
        """Replaces the graph, or (``touched``) the buckets of those numbers by the rows given, which are all that these
        buckets then hold. What it replaces stays until the next write, for readers that still use it.

        ``base`` is the pointer that the rows were worked out from: StoreConflict if it is no longer the current one.
        ``applied`` is kept in the pointer (what a watch has done so far)."""
        meta = self._meta() or {}
        if meta and meta.get("format") != STORE_VERSION:
            raise StoreError(f"{self.root} has format {meta.get('format')}; clean it first")
        if base is not None and meta.get("current") != base.get("current"):
            raise StoreConflict(f"{self.root} was written to meanwhile")
        if touched is None or not meta:
            buckets = max(LEAST_BUCKETS, structs.count() // BUCKET_ROWS)
            tables = {name: {} for name in self.TABLES}
        else:
            buckets = meta["buckets"]
            tables = {name: {k: v for k, v in places.items() if int(k) not in touched} for name, places in meta["tables"].items()}
        version = f"v{uuid.uuid4().hex}"
        # One place for each id, as two structs may have the same one.
        home = structs.groupBy(F.col("id").alias("_id")).agg(F.min(bucket_of("path", buckets)).alias("bucket"))
        at = {
            "structs": structs.withColumn("bucket", bucket_of("path", buckets)),
            "edges": edges.join(home, F.col("source_id") == F.col("_id")),
            "vectors": vectors.join(home, F.col("struct_id") == F.col("_id")),
        }
        for name, df in at.items():
            out = df.select("bucket", *[F.col(f.name).cast(f.dataType) for f in self.TABLES[name]])
            by = ["bucket", "type"] if name == "structs" else ["bucket"]
            out.repartition("bucket").write.partitionBy(*by).parquet(f"{self.root}/{name}/version={version}")
            fs, path = self._fs(f"{self.root}/{name}/version={version}")
            there = [s.getPath().getName() for s in fs.listStatus(path)]
            tables[name] |= {x.partition("=")[2]: version for x in there if x.startswith("bucket=")}
        new = {"format": STORE_VERSION, "buckets": buckets, "tables": tables, "current": version, "written": time.time(), "applied": applied or meta.get("applied")}
        kept = self._places(new)
        old = self._places(meta)
        new["outdated"] = sorted(old - kept)
        self._flip(new)
        for place in meta.get("outdated", []):
            fs, path = self._fs(f"{self.root}/{place}")
            fs.delete(path, True)

    @staticmethod
    def _places(meta: dict) -> set[str]:
        return {f"{name}/version={v}/bucket={k}" for name, places in meta.get("tables", {}).items() for k, v in places.items()}

    def update_descriptions(self, said: DataFrame) -> None:
        """Puts the descriptions of ``said(id, description)``, or ``said(id, uid, description)``, in place of the stored
        ones; only the buckets of these structs are written."""
        meta = self.require()
        key = "uid" if "uid" in said.columns else "id"
        new = said.select(F.col(key).alias("_said"), F.col("description").alias("_new")).dropDuplicates(["_said"])
        hit = self.read("structs", meta=meta).join(new, F.col(key) == F.col("_said"), "left_semi").select(bucket_of("path", meta["buckets"]).alias("k")).distinct()
        touched = sorted(r["k"] for r in hit.collect())
        if touched:
            structs, edges, vectors = self.tables(touched, meta)
            full = structs.join(new, F.col(key) == F.col("_said"), "left").withColumn("description", F.coalesce("_new", "description"))
            self.write(full.select(*STRUCTS.fieldNames()), edges, vectors, touched, meta)

    def _flip(self, meta: dict) -> None:
        fs, temp = self._fs(f"{self.root}/_meta.{uuid.uuid4().hex}")
        stream = fs.create(temp)
        stream.write(bytearray(json.dumps(meta).encode()))
        stream.close()
        final = self._fs(f"{self.root}/_meta.json")[1]
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(temp), fs.makeQualified(final), options)

    def clean(self) -> bool:
        """Deletes the store; whether there was one."""
        fs, path = self._fs(self.root)
        return fs.delete(path, True)
