"""Keeping a store current: a streaming source of file changes and the batch function that applies them.

A build takes a snapshot of the tree before it reads any file and keeps it under an epoch of its own, which the store's
pointer names; a watch starts from there, so what changes between the build and the watch (or while none runs) is not
lost. The pointer also says which batch was applied last, so a batch that comes again is passed over.
"""

from __future__ import annotations

import json
import logging
import os
import shutil
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..operators import describe as describing
from ..operators import graph, reuse
from ..operators.resolve import Resolver
from ..schema import CHANGES, PARSED, STRUCTS
from ..scratch import save, scratch_root
from ..sources.ignore import IgnoreRules
from ..sources.tree import ancestors, as_tuple, language_of, parse_bytes, walk
from ..store import StoreConflict, bucket_of

LOG = logging.getLogger(__name__)
ADDED, MODIFIED, DELETED = "added", "modified", "deleted"
#: Times that a batch is worked out anew because another writer came first.
TRIES = 3


def snapshot(root: str, language: str | None = None) -> dict[str, list]:
    """Size and modification time of every file that the ignore rules let through; -1 for directories."""
    out = {}
    for path, is_dir in walk(root, IgnoreRules.load(root, language), language):
        s = os.stat(os.path.join(root, path))
        out[path] = [-1, -1] if is_dir else [s.st_size, s.st_mtime_ns]
    return out


def diff(before: dict, after: dict) -> list[tuple[str, str]]:
    """Changed files, and directories that are gone; a new directory shows with its files."""
    changes = [(p, DELETED) for p in before if p not in after]
    changes += [(p, ADDED if p not in before else MODIFIED) for p, s in after.items() if before.get(p) != s and s[0] >= 0]
    return sorted(changes)


class ChangeLog:
    """Snapshots and batches of changes of one epoch, by number, in a folder below the project."""

    def __init__(self, base: str, epoch: str):
        self.folder = os.path.join(base, epoch)

    def path(self, kind: str, seq: int) -> str:
        return os.path.join(self.folder, f"{kind}-{seq:09d}.json")

    def put(self, kind: str, seq: int, what) -> None:
        os.makedirs(self.folder, exist_ok=True)
        temp = f"{self.path(kind, seq)}.{uuid.uuid4().hex}"
        with open(temp, "w", encoding="utf-8") as f:
            json.dump(what, f)
        os.replace(temp, self.path(kind, seq))

    def get(self, kind: str, seq: int, default):
        try:
            with open(self.path(kind, seq), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return default

    def forget(self, kind: str, below: int) -> None:
        for k in range(below - 1, -1, -1):
            if not os.path.exists(self.path(kind, k)):
                break
            os.remove(self.path(kind, k))


def changes_folder(root: str) -> str:
    return os.path.join(os.path.abspath(root), ".sylva", "changes")


def begin_epoch(root: str, language: str | None = None, keep: str | None = None) -> dict:
    """Keeps a snapshot of the tree as it is now, as a build's first act; what the store's pointer is to hold of it.
    Epochs other than that one and ``keep`` (the one before, which a watch may still follow) are forgotten."""
    epoch, base = uuid.uuid4().hex, changes_folder(root)
    ChangeLog(base, epoch).put("snapshot", 0, snapshot(root, language))
    for name in os.listdir(base):
        if name not in (epoch, keep):
            shutil.rmtree(os.path.join(base, name), ignore_errors=True)
    return {"epoch": epoch, "seq": 0}


class _ChangeReader(SimpleDataSourceStreamReader):
    """Offsets count the batches of an epoch; each batch's changes and the snapshot after it are kept, so a restarted
    query sees the same batches again and then what changed meanwhile. Without a snapshot to go by all files are new."""

    def __init__(self, options):
        self.root, self.base, self.language = options["path"], options["state"], options.get("language")
        self.begin = {"epoch": options["epoch"], "seq": int(options.get("seq", 0))}

    def initialOffset(self):
        return self.begin

    def _here(self, offset):
        """The offset, or the start where it is of an epoch before a later build."""
        return offset if offset["epoch"] == self.begin["epoch"] else self.begin

    def read(self, start):
        here = self._here(start)
        log, seq = ChangeLog(self.base, here["epoch"]), here["seq"]
        end = {"epoch": here["epoch"], "seq": seq + 1}
        rows = log.get("changes", seq + 1, None)  # prepared before a restart
        if rows is None:
            now = snapshot(self.root, self.language)
            changes = diff(log.get("snapshot", seq, {}), now)
            if not changes:
                return iter([]), start
            rows = [(p, c, seq + 1) for p, c in changes]
            log.put("snapshot", seq + 1, now)
            log.put("changes", seq + 1, rows)
        return iter([tuple(c) for c in rows]), end

    def readBetweenOffsets(self, start, end):
        log, first = ChangeLog(self.base, end["epoch"]), start["seq"] if start["epoch"] == end["epoch"] else 0
        return iter([tuple(c) for k in range(first + 1, end["seq"] + 1) for c in log.get("changes", k, [])])

    def commit(self, end):
        log = ChangeLog(self.base, end["epoch"])
        log.forget("snapshot", end["seq"])
        log.forget("changes", end["seq"])


class SourceChanges(DataSource):
    """``spark.readStream.format("source_changes").option("state", dir).option("epoch", name).load(root)``: path, change,
    seq."""

    @classmethod
    def name(cls):
        return "source_changes"

    def schema(self):
        return CHANGES

    def simpleStreamReader(self, schema):
        return _ChangeReader(self.options)


def read_files(spark, root: str, paths: list[str]) -> DataFrame:
    """Parsed rows of files below a shared root; files that are gone or unsupported give none."""

    def work(frames):
        for f in frames:
            rows = []
            for path in f["path"]:
                full = os.path.join(root, path)
                if language_of(path) and os.path.isfile(full):
                    with open(full, "rb") as g:
                        rows += parse_bytes(path, g.read())
            yield pd.DataFrame([as_tuple(r) for r in rows], columns=PARSED.fieldNames())

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths) // 64)).mapInPandas(work, PARSED)


def apply_changes(project, changes: DataFrame, reresolve: bool = False, mark: dict | None = None) -> dict:
    """Brings the store up to date with a batch of changes, of which only the last of each path counts.

    Changed files are parsed and resolved against the whole graph; what they no longer define is pruned, a file that gives
    nothing is left as it was; unchanged members keep description and vector. Deleting a path takes what is below it along.
    Edges of other files stay, but for those into removed structs, unless ``reresolve`` asks for all dependencies anew. Only
    the buckets of changed paths, of the directories above them and of edges into removed structs are written. While a
    describer works, readers see carried descriptions of the changed files marked stale.

    ``mark`` names the batch (epoch and seq): one that the store has already is passed over. A batch is worked out again
    when another writer came first.
    """
    last = {r["path"]: r["change"] for r in reuse.latest_changes(changes).collect()}
    for k in range(TRIES):
        meta = project.store.require()
        done = meta.get("applied") or {}
        if mark and done.get("epoch") == mark["epoch"] and done["seq"] >= mark["seq"]:
            LOG.info("batch %s is in the store already", mark)
            return {"changed": 0, "deleted": 0, "removed": 0, "buckets": 0}
        try:
            return _apply(project, meta, last, reresolve, mark)
        except StoreConflict:
            if k == TRIES - 1:
                raise
            LOG.warning("the store was written to meanwhile; the batch is worked out again")


def _below(structs: DataFrame, gone: list[str]) -> DataFrame:
    """``(id, path)`` of everything at or below the paths."""
    dropped = structs.sparkSession.createDataFrame([(p,) for p in gone], "gone string")
    above = F.expr("transform(sequence(1, size(split(path, '/'))), k -> array_join(slice(split(path, '/'), 1, k), '/'))")
    return structs.select("id", "path").withColumn("gone", F.explode(above)).join(dropped, "gone", "left_semi").select("id", "path")


def _apply(project, meta: dict, last: dict, reresolve: bool, mark: dict | None) -> dict:
    from ..plans.project import add_vectors, to_structs

    spark, store = project.spark, project.store
    gone = sorted(p for p, c in last.items() if c == DELETED)
    parsed = save(read_files(spark, project.root, sorted(p for p, c in last.items() if c != DELETED)), "parsed")
    files = [r["path"] for r in parsed.select("path").distinct().collect()]
    dirs = ancestors(files, os.path.basename(os.path.abspath(project.root))) if files else []
    touched = spark.createDataFrame([(p,) for p in files], "path string")

    def buckets_of(paths: DataFrame) -> set[int]:
        return {r["k"] for r in paths.select(bucket_of("path", meta["buckets"]).alias("k")).distinct().collect()}

    structs = store.read("structs", meta=meta)
    below = save(_below(structs, gone), "below")
    named = spark.createDataFrame([(p,) for p in [*files, *(d["path"] for d in dirs)]], "path string")
    own = buckets_of(named.unionByName(below.select("path")))
    near, near_edges, near_vectors = store.tables(own, meta)
    doomed = save(below.select("id").unionByName(near.join(touched, "path", "left_semi").where("type <> 'directory'").select("id")).distinct(), "doomed")

    fresh = to_structs(parsed.unionByName(spark.createDataFrame([as_tuple(d) for d in dirs], PARSED)))
    fresh = fresh.join(near.join(doomed, "id", "left_anti").where("type = 'directory'").select("id"), "id", "left_anti").withColumn("vector", F.lit(None).cast("array<float>"))
    previous = near.join(doomed, "id", "left_semi").select("id", "uid", "diff_hash", "description").join(near_vectors, F.col("id") == F.col("struct_id"), "left")
    fresh = save(project._seed(reuse.carry_over(fresh, previous)), "fresh")
    kinds = STRUCTS.fieldNames()
    merged = structs.join(doomed, "id", "left_anti").select(*kinds).unionByName(fresh.select(*kinds))

    resolver = Resolver(merged, None if reresolve else touched)
    exact, fuzzy = resolver.resolve()
    ids = merged.select("uid", "id")
    named_pairs = lambda pairs: pairs.join(ids.select(F.col("uid").alias("source"), F.col("id").alias("s")), "source").join(ids.select(F.col("uid").alias("target"), F.col("id").alias("t")), "target").select(F.col("s").alias("source"), F.col("t").alias("target"))
    found = graph.dependency_edges(named_pairs(exact), named_pairs(fuzzy), merged.select("id", "parent_id"))
    dead = save(doomed.join(fresh.select("id"), "id", "left_anti"), "dead")
    removed = dead.count()

    places = None if reresolve else own | (store.buckets_with_edges_to(dead, meta) if removed else set())
    near, near_edges, near_vectors = store.tables(places, meta)
    kept = near.join(doomed, "id", "left_anti").select(*kinds)
    others = near_edges.limit(0) if reresolve else near_edges.where("edge_type <> 'is_child_of'").join(doomed, F.col("source_id") == F.col("id"), "left_anti").join(dead, F.col("target_id") == F.col("id"), "left_anti")
    edges = save(graph.all_edges(kept.unionByName(fresh.select(*kinds)), others.unionByName(found)), "edges")
    alive = near_vectors.join(doomed, F.col("struct_id") == F.col("id"), "left_anti").unionByName(fresh.where(F.col("vector").isNotNull()).select(F.col("id").alias("struct_id"), "vector"))
    alive = save(alive, "vectors")
    if project.describer is not None:
        store.write(kept.unionByName(reuse.mark_stale(fresh.select(*kinds))), edges, alive, places, meta)
        meta = store.require()
    told = save(describing.describe(fresh.select(*kinds), project.describer), "described")
    full = kept.withColumn(describing.VECTOR_OF, F.lit(None).cast("string")).unionByName(told)
    store.write(full.select(*kinds), edges, add_vectors(full, alive, project.embedder), places, meta, mark)
    count = meta["buckets"] if places is None else len(places)
    LOG.info("%d paths changed, %d deleted, %d structs removed, %d of %d buckets written", len(last) - len(gone), len(gone), removed, count, meta["buckets"])
    return {"changed": len(last) - len(gone), "deleted": len(gone), "removed": removed, "buckets": count}


def watch(project, checkpoint: str | None = None, seconds: float = 1.0):
    """A streaming query that applies changes as they appear, from those on that came after the last build or batch; one
    micro-batch at a time is the single writer."""
    spark = project.spark
    spark.dataSource.register(SourceChanges)
    base = checkpoint or f"{scratch_root(spark)}/watch-{uuid.uuid4().hex}"
    begin = project.store.require().get("applied") or {"epoch": uuid.uuid4().hex, "seq": 0}
    stream = spark.readStream.format("source_changes").option("state", changes_folder(project.root)).option("epoch", begin["epoch"]).option("seq", begin["seq"])
    if project.config.language != "auto":
        stream = stream.option("language", project.config.language)

    def step(batch, _):
        if not batch.isEmpty():
            apply_changes(project, batch, mark={"epoch": begin["epoch"], "seq": batch.agg(F.max("seq")).first()[0]})

    return stream.load(project.root).writeStream.foreachBatch(step).option("checkpointLocation", base).trigger(processingTime=f"{seconds} seconds").start()


class Watchers:
    """The running watches by project root; starting one again replaces it."""

    def __init__(self):
        self.queries = {}

    def start(self, project, **how):
        root = os.path.abspath(project.root)
        self.stop(root)
        self.queries[root] = project.watch(**how)
        return self.queries[root]

    def stop(self, root: str) -> bool:
        query = self.queries.pop(os.path.abspath(root), None)
        if query is not None and query.isActive:
            query.stop()
        return query is not None

    def stop_all(self) -> None:
        for root in list(self.queries):
            self.stop(root)
