import random

import numpy as np
import xxhash
from conftest_llm import ODD

from sylva.llm import simhash
from sylva.llm.common import connected_components


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c == " " or "\x09" <= c <= "\x0d":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in [*ODD[:11], "One two THREE four Five six seven", "Éa ÉB ß c\x0bd\x0ce"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text), text


def brute(fps):
    """Component of each position by comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def clustered(n, seed):
    rng, out = random.Random(seed), []
    while len(out) < n:
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 1, 2, 9])):
            out.append(f)
            for b in rng.sample(range(64), rng.choice([1, 2, 3])):
                f ^= 1 << b
    return out[:n]


def test_tree_finds_every_pair(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 500)
    fps = np.array(sorted(set(clustered(1500, 3))), np.uint64)
    want = {(a, b) for a in map(int, fps) for b in map(int, fps) if a < b and bin(a ^ b).count("1") <= 2}
    met = []
    tree = simhash.plant(fps[::7], 4)
    shards = {}
    for at, shard, home in simhash.route(tree, fps):
        shards.setdefault(shard, []).append((fps[at], home))
    assert len(shards) > 8
    for own in shards.values():
        f, h = np.concatenate([x for x, _ in own]), np.concatenate([y for _, y in own])
        for a, b in simhash.near_pairs(f[h], f[~h]):
            met += [tuple(sorted(x)) for x in zip(map(int, a), map(int, b))]
    assert sorted(met) == sorted(want)  # each pair once


def test_shards_stay_bounded_at_any_depth(monkeypatch, spark):
    """More shards than any fixed depth of twelve would give room for, in proportion; visitors cross one way."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", 1)
    fps = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 9000))
    dealt, shards = simhash.deal(spark.createDataFrame([(int(f),) for f in fps], "fp long"))
    sizes = dealt.where("home").groupBy("shard").count().toPandas()["count"]
    assert shards > 4096 and sizes.sum() == len(fps) and sizes.max() < 40


def test_forest():
    a, b = np.array([1, 2, 9, 4], np.uint64), np.array([2, 3, 8, 4], np.uint64)
    assert dict(zip(*map(list, simhash.forest(a, b)))) == {2: 1, 3: 1, 9: 8}


def test_components_of_fingerprints(spark, docs, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 60)
    fps = clustered(400, 5)
    table = dict(enumerate(fps))
    frame = docs(*[(i, str(i)) for i in table])
    signed = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in table.items()], "id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: signed)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame).collect()}
    assert [got[i]["component_id"] for i in range(400)] == brute(fps)
    assert all(int(got[i]["fingerprint"], 16) == fps[i] for i in range(400))


def test_odd_rows(docs):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b c"), (5, "a b")]
    got = simhash.near_duplicates(docs(*rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[0]["fingerprint"] == "0" * 16 and by[2]["component_id"] == 0 and by[8]["component_id"] == 7
    assert by[None]["component_id"] is None
    assert simhash.near_duplicates(docs()).collect() == []


def test_connected_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 99), (99, 99), (None, 3), (7, 7), (200, 300), (300, 250)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 99: 99, 100: 99, 200: 200, 250: 200, 300: 200}
