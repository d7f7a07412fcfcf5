"""The engine over one source tree: build, query, export, watch."""

from __future__ import annotations

import logging
import os
import time
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import described, embed_text, in_subtree, struct_id
from ..operators import describe as describing
from ..operators import graph, reuse, search, tree
from ..operators.resolve import resolve
from ..schema import CHILD, CLASS, DIRECTORY, FIELD, FILE, METHOD, STRUCTS
from ..scratch import save
from ..sources import lockfile
from ..sources.ignore import default_rules
from ..sources.tree import read_tree, relative
from ..store import Store

LOG = logging.getLogger(__name__)


@dataclass
class Config:
    """Options of a project: given ones, then ``sylva.toml``, then defaults. ``llm`` holds the describer's ``strategy``
    (by name) and its options."""

    language: str = "auto"
    use_lockfile: bool = True
    llm: dict = field(default_factory=dict)

    @classmethod
    def load(cls, root: str, **given) -> Config:
        path, held = os.path.join(root, "sylva.toml"), {}
        if os.path.exists(path):
            with open(path, "rb") as f:
                held = tomllib.load(f)
        known = {k: held[k] for k in ("language", "use_lockfile", "llm") if k in held}
        config = cls(**(known | {k: v for k, v in given.items() if v is not None}))
        if config.language not in ("auto", "python", "java", "html"):
            raise ValueError(f"unknown language: {config.language}")
        return config


def to_structs(parsed: DataFrame) -> DataFrame:
    """Parsed rows as structs: ids from uids, the parent's id by its own row's type."""
    rows = parsed.withColumn("id", struct_id("uid", "type"))
    parents = rows.select(F.col("uid").alias("parent_uid"), F.col("id").alias("parent_id")).where(F.col("parent_uid").isNotNull())
    return rows.join(parents, "parent_uid", "left").withColumn("parent_id", F.when(F.col("parent_id") != F.col("id"), F.col("parent_id"))).withColumn("description", F.lit(None).cast("string"))


def dependencies(structs: DataFrame) -> DataFrame:
    """Rolled-up dependency edges of structs (with parent_uid), resolved among themselves."""
    exact, fuzzy = resolve(structs)
    ids = structs.select("uid", "id")
    of = lambda pairs: pairs.join(ids.select(F.col("uid").alias("source"), F.col("id").alias("s")), "source").join(ids.select(F.col("uid").alias("target"), F.col("id").alias("t")), "target").select(F.col("s").alias("source"), F.col("t").alias("target"))
    return graph.dependency_edges(of(exact), of(fuzzy), structs.select("id", "parent_id"))


def add_vectors(told: DataFrame, vectors: DataFrame, embedder=None) -> DataFrame:
    """Vectors for structs that have none, as the description says (VECTOR_OF): their own, that of another struct, or
    none; fields have none at all."""
    rows = told.where(F.col("type") != FIELD).join(vectors.select("struct_id"), F.col("id") == F.col("struct_id"), "left_anti")
    of = F.col(describing.VECTOR_OF)
    own = rows.where(of.isNull()).select("id", embed_text("uid", "description", "body", "signature", "name").alias("text"))
    every = save(vectors.unionByName(search.embed(own, embedder)), "embedded")
    taken = rows.where(of != "").select("id", of.alias("of")).join(every, F.col("of") == F.col("struct_id")).select(F.col("id").alias("struct_id"), "vector")
    return every.unionByName(taken)


class Project:
    """A source tree and its store. ``describer`` and ``embedder`` are pluggable; the default describes nothing and
    embeds by hashing. ``describers`` are factories by name, for the ``llm`` strategy of the configuration or a build."""

    LOCK = "sylva.lock.json"

    def __init__(self, spark: SparkSession, root: str, store: str | None = None, describer=None, embedder=None, describers: dict | None = None, **config):
        self.spark, self.root = spark, root
        self.store = Store(spark, store or os.path.join(os.path.abspath(root), ".sylva", "store"))
        self.config = Config.load(root, **config)
        self.describers, self.embedder, self.watcher = describers or {}, embedder, None
        self.describer = describer or self._describer(None)

    def _describer(self, name: str | None):
        """The describer of that name, else of the configuration's; ValueError for an unknown one."""
        options = dict(self.config.llm)
        chosen = options.pop("strategy", None)
        return describing.strategy(name or chosen, self.describers, **options)

    # -- building

    def init(self, force: bool = False) -> list[str]:
        """Writes a configuration and an ignore file with the defaults, and keeps the store out of version control;
        files that are there stay unless ``force``. Returns what was written."""
        rules = "\n".join(default_rules(self.config.language)) + "\n"
        wanted = {"sylva.toml": 'language = "auto"\nuse_lockfile = true\n', ".sylvaignore": rules}
        done = []
        for name, text in wanted.items():
            path = os.path.join(self.root, name)
            if force or not os.path.exists(path):
                with open(path, "w", encoding="utf-8") as f:
                    f.write(text)
                done.append(name)
        path = os.path.join(self.root, ".gitignore")
        held = ""
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                held = f.read()
        if ".sylva/" not in held.splitlines():
            with open(path, "w", encoding="utf-8") as f:
                f.write(held + ("" if not held or held.endswith("\n") else "\n") + ".sylva/\n")
            done.append(".gitignore")
        return done

    def parse(self, use_cache: bool = True, language: str | None = None, no_llm: bool = False, llm: str | None = None) -> dict:
        """Builds the graph of the tree as it is now; what is unchanged since the last build keeps its description and
        vector. ``no_llm`` describes nothing this time, ``llm`` names another describer. An incompatible store is wiped
        first. Returns counts of what was read, carried over, resolved, described and embedded."""
        from ..streaming.watch import begin_epoch

        began = time.time()
        describer = None if no_llm else self._describer(llm) if llm else self.describer
        if self.store.exists() and not self.store.is_compatible():
            self.store.clean()
        language = language or self.config.language
        last = ((self.store.require().get("applied") or {}) if self.store.exists() else {}).get("epoch")
        applied = begin_epoch(self.root, language, keep=last)  # before any file is read
        parsed = save(read_tree(self.spark, self.root, language), "parsed")
        structs = save(to_structs(parsed), "structs")
        deps = dependencies(structs)
        rows = structs.withColumn("vector", F.lit(None).cast("array<float>"))
        if use_cache and self.store.exists():
            old, _, vectors = self.store.tables()
            previous = old.select("id", "uid", "diff_hash", "description").join(vectors, F.col("id") == F.col("struct_id"), "left")
            rows = reuse.carry_over(rows, previous)
        else:
            rows = rows.withColumn("carried", F.lit(False))
        rows = save(self._seed(rows), "carried")
        LOG.info("%s: parsed and resolved in %.1f s", self.root, time.time() - began)
        told = save(describing.describe(rows.select(*STRUCTS.fieldNames()), describer), "described")
        known = rows.where(F.col("vector").isNotNull()).select(F.col("id").alias("struct_id"), "vector")
        self.store.write(told.select(*STRUCTS.fieldNames()), graph.all_edges(structs, deps), add_vectors(told, known, self.embedder), applied=applied)
        _, edges, vectors = self.store.tables()
        n, carried = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("carried").cast("int")), F.lit(0))).first()
        before = rows.where(described("description")).count()
        counts = {"structs": n, "carried": carried, "resolved": edges.where(F.col("edge_type") != CHILD).count(), "described": told.where(described("description")).count() - before, "embedded": vectors.count() - known.count()}
        LOG.info("%s: %s", self.root, counts)
        return counts | {"seconds": time.time() - began}

    def sync(self, use_cache: bool = True, watch: bool = True, **how) -> dict | None:
        """What a session starts with: a store that is there is taken as it is (None), else, or without ``use_cache``,
        the tree is parsed; then, if wanted, a watch brings in what changed since."""
        counts = None
        if not (use_cache and self.store.is_compatible()):
            counts = self.parse(use_cache, **how)
        if watch:
            self.watch()
        return counts

    def _seed(self, rows: DataFrame) -> DataFrame:
        entries = lockfile.read(os.path.join(self.root, self.LOCK)) if self.config.use_lockfile else None
        return reuse.seed_from_lock(rows, lockfile.as_frame(self.spark, entries)) if entries else rows

    # -- queries

    def status(self) -> DataFrame:
        """``kind, name, n``: structs by type, edges, vectors, described structs; the store's bytes and when (in seconds
        of the epoch) it was written."""
        meta = self.store.require()
        structs, edges, vectors = self.store.tables(meta=meta)
        count = lambda df, kind, name: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "n")
        by_type = structs.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("struct").alias("kind"), "name", "n")
        held = self.spark.createDataFrame([("store", "bytes", self.store.size()), ("store", "written", int(meta["written"]))], "kind string, name string, n long")
        return by_type.unionByName(count(edges, "edge", "all")).unionByName(count(vectors, "vector", "all")).unionByName(count(structs.where(described("description")), "described", "all")).unionByName(held)

    def skeleton(self, subpath: str = ".", depth: int = 4, files_only: bool = False) -> DataFrame:
        """The tree below a path (an absolute one is taken relative to the root); FileNotFoundError if no file lies there."""
        subpath = relative(self.root, subpath)
        structs = self.store.read("structs")
        below = structs.where(in_subtree("path", subpath))
        if below.where(F.col("type") == FILE).isEmpty():
            raise FileNotFoundError(f"no parsed files below {subpath}")
        return tree.skeleton(below, depth=depth, files_only=files_only, roots=below.where(F.col("uid") == subpath))

    def search(self, query, type_filter: str | None = None, top_k: int = 5, prefilter: bool = False) -> DataFrame:
        """Nearest structs to a text (embedded first) or a vector."""
        vector = (self.embedder or search.HashingEmbedder()).embed([query])[0] if isinstance(query, str) else list(query)
        structs, _, vectors = self.store.tables()
        return search.search(structs, vectors, vector, type_filter, top_k, prefilter)

    def inspect(self, references, include_body: bool = False) -> DataFrame:
        structs, edges, _ = self.store.tables()
        return tree.inspect(structs, edges, coerce_list(references), include_body)

    def impact(self) -> DataFrame:
        structs, edges, _ = self.store.tables()
        return graph.fan(edges, structs)

    # -- text forms

    def render_skeleton(self, subpath: str = ".", depth: int = 4, files_only: bool = False, max_lines: int = 500) -> str:
        return tree.render_skeleton(self.skeleton(subpath, depth, files_only), max_lines)

    def render_search(self, query, type_filter: str | None = None, top_k: int = 5) -> str:
        return "\n".join(f"{r['id']}|{r['uid']} ({r['type']})" for r in self.search(query, type_filter, top_k).collect())

    def render_inspect(self, references, include_body: bool = False, max_lines: int = 500) -> str:
        """A block for each reference: header with its lines, description (left to the child where there is but one),
        dependencies, members by kind, body."""
        found = self.inspect(references, include_body).where("depth < 2").orderBy("pos", "depth", "uid").collect()
        blocks: dict[int, list] = {}
        for r in found:
            blocks.setdefault(r["pos"], []).append(r)
        return tree.cut("\n\n".join(_block(rows[0], rows[1:]) for rows in blocks.values()).splitlines(), max_lines)

    # -- upkeep

    def export_lockfile(self, path: str | None = None, with_vectors: bool = False) -> bool:
        structs, _, vectors = self.store.tables()
        return lockfile.write(path or os.path.join(self.root, self.LOCK), reuse.collect_descriptions(structs, vectors if with_vectors else None), with_vectors)

    def watch(self, checkpoint: str | None = None, seconds: float = 1.0):
        """Starts (or restarts) keeping the store current; returns the streaming query."""
        from ..streaming.watch import watch

        if self.watcher is not None and self.watcher.isActive:
            self.watcher.stop()
        self.watcher = watch(self, checkpoint, seconds)
        return self.watcher

    def clean(self) -> bool:
        if self.watcher is not None and self.watcher.isActive:
            self.watcher.stop()
        return self.store.clean()


def _block(top, children) -> str:
    """One inspected struct as text."""
    if top["error"]:
        return top["error"]
    first, last = top["start_line"], top["end_line"]
    lines = f" @L{first}" + (f"-{last}" if last != first else "") if first and top["type"] != DIRECTORY else ""
    member = top["type"] in (CLASS, METHOD, FIELD)
    out = [f"{top['id']}{lines} | {top['signature'] if member else top['uid']}"]
    if top["description"] and len(children) != 1:
        out.append(f"// {top['description']}")
    out += [f"{sign} {', '.join(top[side])}" for sign, side in (("<", "inbound"), (">", "outbound")) if top[side]]
    for title, kind, shown in (("fields", FIELD, "signature"), ("methods", METHOD, "signature"), ("classes", CLASS, "uid"), ("files", FILE, "uid"), ("directories", DIRECTORY, "uid")):
        own = [c for c in children if c["type"] == kind]
        out += [f"{title}:"] if own else []
        for c in own:
            out.append(f"    {c['id']} | {c[shown]}")
            out += [f"        // {c['description']}"] if c["description"] and kind != FIELD else []
    if top["body"]:
        out += ["```", *top["body"].splitlines(), "```"]
    return "\n".join(out)


def coerce_list(value) -> list[str]:
    """A list, a JSON list or comma-separated text as a list of references."""
    import json

    if isinstance(value, str):
        text = value.strip()
        if text.startswith("["):
            try:
                return [str(x) for x in json.loads(text)]
            except ValueError:
                pass
        if "," in text and "(" not in text:
            return [x.strip() for x in text.split(",") if x.strip()]
        return [text] if text else []
    return [str(x) for x in value]
