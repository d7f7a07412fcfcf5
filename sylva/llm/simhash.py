"""SimHash near-duplicates over vantage-point trees.

Every text becomes a 64-bit fingerprint of its three-word shingles. Distinct fingerprints are dealt to the leaves
(shards) of a vantage-point tree: each inner node holds a vantage fingerprint and a radius, and a fingerprint lives
inside or outside of that radius. One that lives inside but within ``LINK_BITS`` of the boundary also visits the
outside (never the other way round), and goes on from there to every child that may hold a partner; so each pair at
distance <= LINK_BITS meets in exactly one shard, the home of the member that was outside where the two parted.
Within a shard the same recursion goes on in numpy, pruned by the triangle inequality, down to small blocks that are
compared exactly. The result is exact whatever sample the tree was drawn from; the sample only balances the shards.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, small_batches

LINK_BITS = 2
#: Fingerprints drawn (by hash order) to place vantages and radii: so many at least, and so many for each shard. They only
#: balance the shards; eight bytes each.
TREE_SAMPLE, SHARD_SAMPLE = 8192, 64
#: Distinct fingerprints that a shard should hold; the tree is as deep as that asks for.
SHARD_ROWS = 1_000_000
#: Pairs compared at once.
BLOCK = 1 << 16
#: Links held before they are reduced to spanning ones.
HELD = 1 << 21


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash: A-Z lower-cased, three-word shingles with repeats (fewer words: all of them), XXH64
    seed 42; a bit is 1 if set in over half the hashes. No word: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b"%b %b %b".__mod__, zip(words, words[1:], words[2:])) if len(words) > 2 else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` of every row, fp a long holding the 64 bits. Null and wordless texts have fingerprint 0."""

    def work(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(work, "id long, fp long")


def _distance(fps: np.ndarray, v) -> np.ndarray:
    return np.bitwise_count(fps ^ v)


def _split(fps: np.ndarray, vantage) -> tuple[int, np.ndarray] | None:
    """The median distance from the vantage (or one less, where that leaves no outside) and who lives inside; None
    where all are at one distance."""
    d = _distance(fps, vantage)
    radius = int(np.median(d))
    if d.max() == radius:
        radius -= 1
    inside = d <= radius
    return (radius, inside) if inside.any() else None


def plant(sample: np.ndarray, depth: int, leaves: list | None = None):
    """A tree over a sample: ``(vantage, radius, inside, outside)`` at inner nodes, the shard's number at leaves."""
    leaves = [0] if leaves is None else leaves
    if depth and len(sample) > 1 and (cut := _split(sample, sample[0])):
        radius, inside = cut
        return sample[0], radius, plant(sample[inside], depth - 1, leaves), plant(sample[~inside], depth - 1, leaves)
    leaves[0] += 1
    return leaves[0] - 1


def route(tree, fps: np.ndarray, reach: int = LINK_BITS):
    """Yields ``(positions, shard, home)``: home for the members of a shard, not home for its visitors."""
    stack = [(tree, np.arange(len(fps)), True), (tree, np.empty(0, int), False)]
    while stack:
        node, at, home = stack.pop()
        if not len(at):
            continue
        if not isinstance(node, tuple):
            yield at, node, np.full(len(at), home)
            continue
        vantage, radius, inside, outside = node
        d = _distance(fps[at], vantage).astype(np.int64)
        if home:
            stack += [(inside, at[d <= radius], True), (outside, at[d > radius], True)]
            stack.append((outside, at[(d <= radius) & (d > radius - reach)], False))
        else:
            stack += [(inside, at[d <= radius + reach], False), (outside, at[d > radius - reach], False)]


def _compared(m: np.ndarray, q: np.ndarray | None, reach: int):
    """Yields the pairs of m and q (None: of m with itself, once) at distance <= reach, all compared."""
    other = m if q is None else q
    step = max(1, BLOCK // len(m))
    for at in range(0, len(other), step):
        near = np.bitwise_count(m[:, None] ^ other[None, at : at + step]) <= reach
        if q is None:
            near &= m[:, None] < other[None, at : at + step]
        i, j = np.nonzero(near)
        yield m[i], other[at + j]


def near_pairs(members: np.ndarray, visitors: np.ndarray, reach: int = LINK_BITS):
    """Yields arrays of the pairs at distance <= reach among members (each once) and between members and visitors."""
    stack = [(members, None), (members, visitors)]
    while stack:
        m, q = stack.pop()
        if not len(m) or q is not None and not len(q):
            continue
        if q is not None and len(q) > len(m):
            m, q = q, m
        if len(m) * len(m if q is None else q) <= BLOCK or (cut := _split(m, m[len(m) // 2])) is None:
            yield from _compared(m, q, reach)
            continue
        radius, inside = cut
        vantage = m[len(m) // 2]
        if q is None:
            d = _distance(m, vantage).astype(np.int64)
            stack += [(m[inside], None), (m[~inside], None), (m[inside & (d > radius - reach)], m[~inside & (d <= radius + reach)])]
        else:
            d = _distance(q, vantage).astype(np.int64)
            stack += [(m[inside], q[d <= radius + reach]), (m[~inside], q[d > radius - reach])]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links a-b: ``(node, smallest node of its component)``, roots left out."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(i):
        ri, rj = root[i], root[j]
        open_ = ri != rj
        if not open_.any():
            break
        i, j, ri, rj = i[open_], j[open_], ri[open_], rj[open_]
        low = np.minimum(ri, rj)
        np.minimum.at(root, ri, low)
        np.minimum.at(root, rj, low)
        while not np.array_equal(up := root[root], root):
            root = up
    others = root != np.arange(len(nodes))
    return nodes[others], nodes[root[others]]


def _links_of_shard(key, frame: pd.DataFrame) -> pd.DataFrame:
    fps, home = frame["fp"].to_numpy().view(np.uint64), frame["home"].to_numpy()
    none = np.empty(0, np.uint64)
    held, size = [(none, none)], 0
    for pair in near_pairs(fps[home], fps[~home]):
        held.append(pair)
        size += len(pair[0])
        if size > HELD:
            held = [forest(*map(np.concatenate, zip(*held)))]
            size = len(held[0][0])
    a, b = forest(*map(np.concatenate, zip(*held)))
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def deal(fps: DataFrame) -> tuple[DataFrame, int]:
    """``(fp, shard, home)`` of distinct ``fp`` values in every shard they belong to or visit, and the number of shards."""
    shards = 1 << max(0, (fps.count() // SHARD_ROWS).bit_length())
    sample = fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(max(TREE_SAMPLE, SHARD_SAMPLE * shards)).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    leaves = [0]
    tree = plant(sample, shards.bit_length() - 1, leaves)

    def work(batches):
        for b in batches:
            own = b.column(0).to_numpy().view(np.uint64)
            for at, shard, home in route(tree, own):
                yield pa.RecordBatch.from_arrays([pa.array(own[at].view(np.int64)), pa.array(np.full(len(at), shard, np.int32)), pa.array(home)], ["fp", "shard", "home"])

    return fps.select("fp").mapInArrow(work, "fp long, shard int, home boolean"), leaves[0]


def link(fps: DataFrame) -> DataFrame:
    """Spanning links ``(a, b)`` between distinct ``fp`` values at distance <= LINK_BITS: a star for each component
    found in each shard, so a dense group gives as many rows as it has members."""
    dealt, shards = deal(fps)
    # A task for each shard: their few bytes would otherwise be put together into few tasks.
    return dealt.repartition(shards, "shard").groupBy("shard").applyInPandas(_links_of_shard, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: ``doc_id, fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable).

    Equal fingerprints are one node, so copies cost one row each and no pair. Null, empty and wordless texts share
    fingerprint zero and link like any other; long ones are read whole. Rows repeated with the same id are each
    returned; rows without an id take part in nothing and return component null. Only the two columns named are read,
    so extra ones cannot clash. An empty table gives an empty result.
    """
    prints = Scratch(fingerprints(docs, id_col, text_col), "fingerprints").df
    groups = Scratch(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("low")), "groups").df
    links = Scratch(link(groups), "near").df
    by_id = links.join(groups.select(F.col("fp").alias("a"), F.col("low").alias("la")), "a").join(groups.select(F.col("fp").alias("b"), F.col("low").alias("lb")), "b")
    found = connected_components(by_id.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    known = groups.join(found, F.col("low") == F.col("node"), "left").select("fp", F.coalesce("component", "low").alias("component"))
    return prints.join(known, "fp", "left").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"),
    )
