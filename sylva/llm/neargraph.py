"""Embedding near-dedup over a robust-pruned flat graph.

Equal vectors of a label become one node that carries its count. A label with many nodes is cut into shards around
centroids, each node belonging to its ``overlap`` nearest ones; a shard that is still large is cut again, so that shards
stay small at any size, unless centroids cannot part its nodes (a dense group). In every shard the nodes' nearest
candidates are pruned by the robust rule (a candidate goes when a kept one is ``ALPHA`` times closer to it than the node
is), and a node's lists from all its shards are united. Nearest-neighbour lists leave some nodes of a dense group without
any link into them, so each node is also linked with the two next to it in the order of nearest medoid and similarity to
it. Each node then is a query: a greedy beam search from the shard's medoids, then an expansion through everything within
``SLACK`` of the threshold. What it finds is verified by cosine in double precision. A pair counts for both its nodes
whichever of them found it, in the first shard that both share: pairs that meet in a later shard too are compared exactly
in the first, so none that a later one finds is left uncounted, and none counts twice. There also a spanning star of each
component is kept, so a dense group costs rows in proportion to its members. A dense group of more than ``PART_ROWS``
nodes is dealt to blocks, and a task compares two of them, all pairs.

Finding is approximate: queries, whose number grows with the table, are compared with all rows of their label, and
while recall is under ``LEAST_RECALL`` the graph is built again with twice the overlap. Queries are the ids divisible by
50 (up to ``MOST_AUDIT`` of them, by hash), and others where these are few. Recall is the mean over the queries that have
a true link of the share of their links that was found, and those with few links must reach it by themselves; as links are
never wrong and counted once, shares of counts are shares of links. The log has it. Where it is still missed after
``TRIES``, or too few queries have a link to tell, all pairs of each label are compared instead, in blocks.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components
from .simhash import forest

LOG = logging.getLogger(__name__)
LEAST = 0.98
#: Nodes for each centroid; a shard with four times as many is cut, by FAN centroids at most, and cut again.
SHARD_ROWS, FAN = 500, 64
#: Nodes drawn (by hash) for each centroid to place them; Lloyd steps on these; centroids more alike than this are one, so
#: that a dense group stays together; a shard that keeps more than this part of the one it was cut from is not cut again.
DRAWN, LLOYD, ALIKE, STUCK = 16, 4, 0.85, 0.75
#: Nodes that share a copy of the centroids while they are dealt.
DEALT_ROWS = 20_000
OVERLAP, CANDIDATES, DEGREE, ALPHA, MEDOIDS, BEAM, SLACK = 2, 24, 12, 1.2, 16, 8, 0.03
#: Nodes of a shard that is searched as a graph at most; larger ones (dense groups) are compared in blocks of so many.
PART_ROWS = 8192
#: Tasks for all shards; more shards than that share tasks.
MOST_TASKS = 20_000
#: Queries of the recall audit at least, and what it must reach.
AUDIT, LEAST_RECALL, TRIES = 100, 0.97, 3
#: Queries by the root of the number of nodes; queries with one to FEW linked nodes that are needed to tell (or all nodes
#: asked); queries at most.
AUDIT_ROOT, FEW, NEEDED, MOST_AUDIT = 4, 10, 50, 1 << 15
#: Cells of a queries-by-nodes table in memory.
CELLS = 1 << 22
SHARD = ["label", "dim", "shard"]
DEALT = "label string, dim int, shard long, id long, n long, embedding array<double>, above long"
FOUND = "id long, linked long, root long"


def _unit(rows) -> np.ndarray:
    x = np.array(list(rows), np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def robust_prune(x: np.ndarray, own: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Keeps up to DEGREE of each node's candidates (sorted, nearest first), -1 where there is none."""
    c = x[candidates]
    to_node = 1 - np.einsum("nd,nkd->nk", x[own], c)
    between = 1 - np.einsum("nkd,njd->nkj", c, c)
    alive, kept = candidates != own[:, None], np.zeros(candidates.shape, bool)
    for k in range(candidates.shape[1]):
        take = alive[:, k] & (kept.sum(1) < DEGREE)
        kept[:, k] = take
        alive &= ~(take[:, None] & (ALPHA * between[:, k] <= to_node))
    order = np.argsort(~kept, axis=1, kind="stable")[:, :DEGREE]
    return np.where(np.take_along_axis(kept, order, 1), np.take_along_axis(candidates, order, 1), -1)


def _chunks(own: np.ndarray, n: int):
    step = int(np.clip(CELLS // max(n, 1), 8, 1024))
    for at in range(0, len(own), step):
        yield own[at : at + step]


def build(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Neighbours of the nodes of a shard, by position: pruned nearest ones and those next in order."""
    n, width = len(x), min(len(x), CANDIDATES)
    x = x.astype(np.float32)
    to_start = np.concatenate([x[at : at + 4096] @ x[starts].T for at in range(0, n, 4096)])
    order = np.lexsort((to_start.max(1), to_start.argmax(1)))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    lists = []
    for part in _chunks(np.arange(n), n):
        near = x[part] @ x.T
        top = np.argpartition(-near, width - 1, axis=1)[:, :width]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
        beside = [order[np.clip(place[part] + step, 0, n - 1)][:, None] for step in (-1, 1)]
        lists.append(np.concatenate([robust_prune(x, part, top), *beside], axis=1))
    return np.concatenate(lists)


def medoids(x: np.ndarray) -> np.ndarray:
    """Nodes nearest to the means of a few parts of the shard."""
    k = min(MEDOIDS, len(x))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(2):
        part = np.concatenate([(x[at : at + 4096] @ centres.T).argmax(1) for at in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, part, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
    best, at_best = np.full(k, -2.0), np.zeros(k, int)
    for at in range(0, len(x), 4096):
        near = x[at : at + 4096] @ centres.T
        top = near.argmax(0)
        better = near[top, np.arange(k)] > best
        best[better], at_best[better] = near[top, np.arange(k)][better], top[better] + at
    return np.unique(at_best)


def search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, own: np.ndarray, least: float = LEAST):
    """``(query, node)`` positions at float cosine >= least (a little less), by beam search and range expansion."""
    q = x[own]
    seen = np.zeros((len(own), len(x)), bool)
    score = np.full((len(own), len(x)), -2, np.float32)
    rows = np.arange(len(own))[:, None]
    seen[:, starts] = True
    score[:, starts] = q @ x[starts].T
    first = np.argsort(-score[:, starts], axis=1, kind="stable")[:, :BEAM]
    beam = np.full((len(own), BEAM), -1)
    beam[:, : first.shape[1]] = starts[first]
    reach = np.where(beam >= 0, score[rows, beam], -3)
    done = beam < 0
    while not done.all():
        pick = np.where(done, -4, reach).argmax(1)
        idle = done[rows[:, 0], pick]
        node = beam[rows[:, 0], pick]
        done[rows[:, 0], pick] = True
        near = np.where(idle[:, None], -1, graph[node])
        fresh = (near >= 0) & ~seen[rows, near]
        dots = np.einsum("qd,qkd->qk", q, x[near])
        seen[np.broadcast_to(rows, near.shape)[fresh], near[fresh]] = True
        score[np.broadcast_to(rows, near.shape)[fresh], near[fresh]] = dots[fresh]
        nodes = np.concatenate([beam, np.where(fresh, near, -1)], 1)
        reaches = np.concatenate([reach, np.where(fresh, dots, -3)], 1)
        dones = np.concatenate([done, ~fresh], 1)
        top = np.argpartition(-reaches, BEAM - 1, axis=1)[:, :BEAM]
        beam, reach, done = (np.take_along_axis(v, top, 1) for v in (nodes, reaches, dones))
    i, j = np.nonzero(score >= least - SLACK)
    while len(i):
        ni, nj = [], []
        for at in range(0, len(i), 20_000):
            a, b = np.repeat(i[at : at + 20_000], graph.shape[1]), graph[j[at : at + 20_000]].ravel()
            ok = (b >= 0) & ~seen[a, b]
            a, b = a[ok], b[ok]
            seen[a, b] = True
            pair = np.unique(a * len(x) + b)
            a, b = pair // len(x), pair % len(x)
            for k in range(0, len(a), 100_000):
                score[a[k : k + 100_000], b[k : k + 100_000]] = np.einsum("pd,pd->p", q[a[k : k + 100_000]], x[b[k : k + 100_000]])
            inside = score[a, b] >= least - SLACK
            ni.append(a[inside])
            nj.append(b[inside])
        i, j = np.concatenate(ni), np.concatenate(nj)
    return np.nonzero(score >= least - 1e-4)


def _lists_of_shard(key, frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("id", kind="stable").reset_index(drop=True)
    ids, x = frame["id"].to_numpy(), _unit(frame["embedding"])
    graph = build(x, medoids(x))
    return pd.DataFrame({"label": key[0], "dim": key[1], "shard": key[2], "id": ids, "neighbours": [ids[g[g >= 0]] for g in graph]})


def _search_shard(key, frame: pd.DataFrame) -> pd.DataFrame:
    """Per node: rows linked to it as counted in this shard, and spanning links found here."""
    shard = frame["shard"].iloc[0]
    frame = frame.sort_values("id", kind="stable").reset_index(drop=True)
    ids, exact = frame["id"].to_numpy(), _unit(frame["embedding"])
    x, own = exact.astype(np.float32), np.arange(len(frame))
    lists = frame["neighbours"].tolist()
    graph = np.full((len(ids), max(1, max(map(len, lists)))), -1)
    for k, near in enumerate(lists):
        at = np.searchsorted(ids, near)
        at[at == len(ids)] = 0
        graph[k, : len(near)] = np.where(ids[at] == near, at, -1)
    starts = medoids(x)
    shards, count = _padded(frame["shards"]), frame["n"].to_numpy()
    linked = np.zeros(len(ids), np.int64)
    a = b = np.empty(0, np.int64)
    hit = np.zeros((len(ids), len(ids)), bool)
    for part in _chunks(own, len(ids)):
        i, j = search(x, graph, starts, part)
        hit[part[i], j] = True
    hit |= hit.T
    again = [np.flatnonzero((shards == s).any(1)) for s in np.unique(shards[shards > shard])]
    for part in _chunks(own, len(ids)):
        found = hit[part]
        for m in again:
            at = np.flatnonzero(np.isin(part, m))
            i, j = np.nonzero(x[part[at]] @ x[m].T >= LEAST - 1e-4)
            found[at[i], m[j]] = True
        i, j = np.nonzero(found)
        i = part[i]
        for at in range(0, len(i), 50_000):
            p, q = i[at : at + 50_000], j[at : at + 50_000]
            sure = (p != q) & (np.einsum("pd,pd->p", exact[p], exact[q]) >= LEAST)
            p, q = p[sure], q[sure]
            here = _first_common(shards[p], shards[q]) == shard
            np.add.at(linked, p[here], count[q[here]])
            a, b = forest(np.concatenate([a, p]), np.concatenate([b, q]))
    return pd.DataFrame({"id": np.concatenate([ids, ids[a]]), "linked": np.concatenate([linked, np.zeros(len(a), np.int64)]), "root": np.concatenate([ids, ids[b]])})


def _padded(shards) -> np.ndarray:
    """The nodes' shards as a table, short rows filled up with -1."""
    shards = [list(x) for x in shards]
    out = np.full((len(shards), max(map(len, shards))), -1, np.int64)
    for k, own in enumerate(shards):
        out[k, : len(own)] = own
    return out


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row the least shard that both have."""
    far = np.iinfo(np.int64).max
    return np.where((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0), a[:, :, None], far).min((1, 2))


def _centroids(x: np.ndarray, k: int) -> np.ndarray:
    centres = x[:k]
    for _ in range(LLOYD):
        part = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, part, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
    kept = []
    for k in range(len(centres)):
        if not kept or (centres[kept] @ centres[k]).max() < ALIKE:
            kept.append(k)
    return centres[kept]


def _centroids_of_shard(key, frame: pd.DataFrame) -> pd.DataFrame:
    x = _unit(frame.sort_values("id", kind="stable")["embedding"])
    centres = _centroids(x, int(frame["k"].iloc[0]))
    return pd.DataFrame({"label": key[0], "dim": key[1], "shard": key[2], "embedding": list(centres)})


def nodes_of(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Distinct comparable vectors: ``label, dim, embedding, id`` (smallest of the copies) ``, n`` (rows)."""
    e = F.col(vector_col).cast("array<double>")
    sound = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), e.alias("embedding"), sound.alias("sound")).where("sound")
    return rows.groupBy("label", F.size("embedding").alias("dim"), "embedding").agg(F.min("id").alias("id"), F.count("*").alias("n"))


def _cut(dealt: DataFrame, large: DataFrame, overlap: int) -> DataFrame:
    """The rows of the shards ``large(label, dim, shard, size)``, each in the ``overlap`` shards within its own whose
    centroids are nearest. Centroids are placed on few nodes of a shard, drawn by hash, and travel ahead of its nodes,
    which are dealt to a task for every DEALT_ROWS of them."""
    k = F.least(F.lit(FAN), F.ceil(F.col("size") / SHARD_ROWS)).cast("int")
    wide = dealt.join(large.withColumn("k", k).withColumn("salts", F.ceil(F.col("size") / DEALT_ROWS).cast("int")), SHARD)
    chance = F.pmod(F.xxhash64("id", "shard"), F.lit(1 << 30)) / float(1 << 30)
    drawn = wide.where(chance < DRAWN * F.col("k") / F.col("size")).select(*SHARD, "id", "embedding", "k")
    centres = drawn.groupBy(*SHARD).applyInPandas(_centroids_of_shard, "label string, dim int, shard long, embedding array<double>")
    salts = F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / DEALT_ROWS).cast("int") - 1))
    none = F.lit(None).cast("long")
    ahead = centres.join(large.withColumn("salt", salts).drop("size"), SHARD).select(*SHARD, "salt", F.lit(0).alias("kind"), none.alias("id"), none.alias("n"), "embedding", none.alias("size"))
    rows = wide.select(*SHARD, F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "id", "n", "embedding", "size")
    laid = ahead.unionByName(rows).repartition(*SHARD, "salt").sortWithinPartitions(*SHARD, "salt", "kind", "id")

    def work(frames):
        known, held = None, []
        for frame in frames:
            for key, own in frame.groupby([*SHARD, "salt"], sort=False):
                if key != known:
                    known, held = key, []
                held += list(own.loc[own["kind"] == 0, "embedding"])
                own = own[own["kind"] == 1]
                if not len(own):
                    continue
                near = _unit(own["embedding"]) @ np.array(held).T if held else np.zeros((len(own), 1))
                k = min(overlap, near.shape[1])
                top = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < near.shape[1] else np.tile(np.arange(k), (len(own), 1))
                out = own.loc[own.index.repeat(k), ["label", "dim", "shard", "id", "n", "embedding"]]
                yield out.assign(shard=key[2] * (FAN + 1) + 1 + top.ravel(), above=own["size"].to_numpy(np.int64).repeat(k))

    return laid.mapInPandas(work, DEALT)


def _dealt(nodes: DataFrame, overlap: int) -> tuple[Scratch, DataFrame]:
    """Each node in its shards, and the shards' sizes ``(label, dim, shard, size)``."""
    now = Scratch(nodes.select("label", "dim", F.lit(0).cast("long").alias("shard"), "id", "n", "embedding", F.lit(1 << 62).alias("above")), "dealt")
    while True:
        sizes = Scratch(now.df.groupBy(*SHARD).agg(F.count("*").alias("size"), F.max("above").alias("above")), "sizes").df
        large = sizes.where((F.col("size") > 4 * SHARD_ROWS) & (F.col("size") <= STUCK * F.col("above"))).select(*SHARD, "size")
        if large.isEmpty():
            return now, sizes.drop("above")
        after = Scratch(now.df.join(large, SHARD, "left_anti").select(*now.df.columns).unionByName(_cut(now.df.drop("above"), large, overlap)), "dealt")
        now.drop()
        now = after


def _links(nodes: DataFrame, overlap: int) -> DataFrame:
    """``(id, linked, root)``: rows linked to each node, summed over its rows here, and spanning links (id, root)."""
    dealt, sizes = _dealt(nodes, overlap)
    small, dense = sizes.where(F.col("size") <= PART_ROWS).select(*SHARD), sizes.where(F.col("size") > PART_ROWS)
    tasks = max(1, min(small.count(), MOST_TASKS))
    by_shard = lambda df: df.join(small, SHARD).repartition(tasks, *SHARD).groupBy(*SHARD)

    lists = by_shard(dealt.df.select(*SHARD, "id", "embedding")).applyInPandas(_lists_of_shard, "label string, dim int, shard long, id long, neighbours array<long>")
    if grouped := not dense.isEmpty():
        lists = lists.unionByName(dealt.df.join(dense, SHARD).select(*SHARD, "id", F.array().cast("array<long>").alias("neighbours")))
    union = lists.groupBy("label", "dim", "id").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"), F.collect_set("shard").alias("shards"))
    placed = dealt.df.join(union, ["label", "dim", "id"])
    found = by_shard(placed).applyInPandas(_search_shard, FOUND)
    if grouped:
        found = found.unionByName(_block_pairs(placed, dense))
    out = Scratch(found, "found").df
    dealt.drop()
    return out


def _pairs_of_blocks(key, frame: pd.DataFrame) -> pd.DataFrame:
    """Links between the nodes of two blocks of a shard (or within one), all pairs compared: the columns of ``_links``."""
    ids, x, count, block = frame["id"].to_numpy(), _unit(frame["embedding"]), frame["n"].to_numpy(), frame["block"].to_numpy()
    shard, shards = frame["shard"].iloc[0], _padded(frame["shards"])
    left, right = np.flatnonzero(block == frame["i"].iloc[0]), np.flatnonzero(block == frame["j"].iloc[0])
    within = frame["i"].iloc[0] == frame["j"].iloc[0]
    linked = np.zeros(len(ids), np.int64)
    a = b = np.empty(0, np.int64)
    # Only pairs that may share an earlier shard need a look at where they count.
    early = [np.flatnonzero((shards == s).any(1)) for s in np.unique(shards[(shards >= 0) & (shards < shard)])]
    for part in _chunks(left, len(right)):
        hit = (x[part] @ x[right].T >= LEAST) & (part[:, None] != right[None, :])
        i, j = np.nonzero(hit)
        a, b = forest(np.concatenate([a, part[i]]), np.concatenate([b, right[j]]))
        for m in early:
            hit[np.ix_(np.isin(part, m), np.isin(right, m))] = False
        linked[part] += hit @ count[right]
        if not within:
            linked[right] += count[part] @ hit
    return pd.DataFrame({"id": np.concatenate([ids, ids[a]]), "linked": np.concatenate([linked, np.zeros(len(a), np.int64)]), "root": np.concatenate([ids, ids[b]])})


def _block_pairs(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """As ``_links``, exact, for the shards of ``sizes``: their nodes are dealt to blocks by hash, a task compares two."""
    blocks = sizes.select(*SHARD, F.ceil(F.col("size") / PART_ROWS).cast("int").alias("blocks"))
    dealt = placed.join(blocks, SHARD).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = dealt.select(*SHARD, "id", "embedding", "n", "shards", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return pairs.groupBy(*SHARD, "i", "j").applyInPandas(_pairs_of_blocks, FOUND)


def _all_links(nodes: DataFrame) -> DataFrame:
    """As ``_links``, exact: every label is one shard."""
    whole = F.lit(0).cast("long")
    placed = nodes.withColumn("shard", whole).withColumn("shards", F.array(whole))
    return Scratch(_block_pairs(placed, placed.groupBy(*SHARD).agg(F.count("*").alias("size"))), "found").df


def _asked(nodes: DataFrame, found: DataFrame, queries: int) -> tuple[float, int]:
    """Recall of ``queries`` nodes (ids divisible by 50 first, then by hash), and how many of them have one to FEW linked
    nodes."""
    asked = nodes.orderBy(F.col("id") % 50 != 0, F.xxhash64(F.col("id") + 1), "id").limit(queries).toPandas()
    keys = {k: (own["id"].to_numpy(), _unit(own["embedding"])) for k, own in asked.groupby(["label", "dim"])}

    def work(frames):
        for frame in frames:
            for key, own in frame.groupby(["label", "dim"]):
                if key in keys:
                    x, others, n = _unit(own["embedding"]).T, own["id"].to_numpy(), own["n"].to_numpy()
                    for at in range(0, len(keys[key][0]), 256):
                        ids, q = (v[at : at + 256] for v in keys[key])
                        hit = (q @ x >= LEAST) & (ids[:, None] != others[None, :])
                        some = hit.any(1)
                        yield pd.DataFrame({"id": ids[some], "truth": hit[some] @ n, "near": hit[some].sum(1)})

    truth = nodes.mapInPandas(work, "id long, truth long, near long").groupBy("id").agg(F.sum("truth").alias("truth"), F.sum("near").alias("near"))
    share = F.least("truth", F.coalesce("linked", F.lit(0))) / F.col("truth")
    both = truth.join(found.groupBy("id").agg(F.sum("linked").alias("linked")), "id", "left").groupBy((F.col("near") <= FEW).alias("few")).agg(F.avg(share).alias("recall"), F.count("*").alias("n")).collect()
    return min((r["recall"] for r in both), default=1.0), sum(r["n"] for r in both if r["few"])


def audit(nodes: DataFrame, found: DataFrame, queries: int = AUDIT) -> float | None:
    """The mean share of its true links that ``found(id, linked)`` counts for a node that has any, the less of nodes with
    up to FEW and of others; None where MOST_AUDIT queries were too few to tell."""
    total, fiftieth = nodes.agg(F.count("*"), F.count_if(F.col("id") % 50 == 0)).first()
    queries = max(queries, int(AUDIT_ROOT * total**0.5), min(fiftieth, MOST_AUDIT))
    while True:
        recall, few = _asked(nodes, found, queries)
        LOG.info("recall %.4f over %d queries of %d nodes, %d of them with few links", recall, queries, total, few)
        if few >= NEEDED or queries >= total or recall < LEAST_RECALL:
            return recall
        if queries >= MOST_AUDIT:
            return None
        queries = min(4 * queries, MOST_AUDIT)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of vectors: ``vec_id, n_links`` (other rows linked directly), ``component_id`` (smallest vec_id
    reachable) and ``kept`` (vec_id = component_id).

    Vectors compare when labels are equal and not null and lengths agree. A null vector, a zero one and one that holds
    a null or non-finite component links with nothing and is kept. Rows that repeat a vector link with each other. A
    row without an id gives component null and kept false. Only the three columns are read, so others cannot clash. An
    empty table gives an empty result.
    """
    nodes = Scratch(nodes_of(vectors, id_col, vector_col, label_col), "nodes").df
    overlap = OVERLAP
    for _ in range(TRIES):
        found = _links(nodes, overlap)
        recall = audit(nodes, found)
        if recall is None or recall >= LEAST_RECALL:
            break
        overlap *= 2
    if recall is None or recall < LEAST_RECALL:
        LOG.warning("recall %s at overlap %d: all pairs of each label are compared", "cannot be told" if recall is None else f"{recall:.4f}", overlap)
        found = _all_links(nodes)
    linked = found.groupBy("id").agg(F.sum("linked").alias("linked"))
    parts = connected_components(found.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = nodes.join(linked, "id", "left").join(parts, F.col("id") == F.col("node"), "left")
    known = known.select("label", "embedding", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.col(id_col).isNotNull(), F.col(label_col).cast("string")).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    out = rows.join(known, ["label", "embedding"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
