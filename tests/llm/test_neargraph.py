import numpy as np
import pytest

from sylva.llm import neargraph

VECTORS = "vec_id long, embedding array<float>, label int, id string, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, "extra", 1) for i, v, l in rows], VECTORS)


def brute(rows):
    links = {}
    ok = [(i, np.array(v, np.float32).astype(float), l) for i, v, l in rows if v is not None and l is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    for a, (i, x, l) in enumerate(ok):
        for b, (j, y, m) in enumerate(ok):
            if a != b and l == m and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links.setdefault(i, set()).add(j)
    out = {}
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links.get(i, ())), min(seen), min(seen) == i)
    return out


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(neargraph, "SHARD_ROWS", 60)
    monkeypatch.setattr(neargraph, "PART_ROWS", 80)
    rng, rows = np.random.default_rng(seed), []
    centre = rng.normal(size=64)
    for _ in range(500):
        x = rng.normal(size=64)
        for _ in range(rng.choice([1, 1, 1, 4])):
            rows.append(x + rng.normal(size=64) * rng.choice([0, 0.02, 0.1, 0.2]))
    rows += [centre + rng.normal(size=64) * 0.14 for _ in range(300)]  # one dense group around the threshold
    rows = [(i, v.tolist(), int(rng.integers(0, 2)) if i % 9 else None) for i, v in enumerate(rows)]
    want, got = brute(rows), result(neargraph.near_duplicates(table(spark, rows)))
    assert set(got) == set(want)
    found, true = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert 0.97 * true <= found <= true
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.97 * len(want)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(0, v, 1), (1, v, 1), (2, v, None), (3, None, 1), (4, [0, 0, 0], 1), (5, [None, 1, 2], 1), (6, [float("nan"), 1, 2], 1), (7, [float("inf"), 1, 2], 1), (8, [2, 4, 6], 1), (9, v, 2), (10, [], 1), (11, [1, 2], 1)]
    got = result(neargraph.near_duplicates(table(spark, rows)))
    assert got == {i: (2, 0, i == 0) if i in (0, 1, 8) else (0, i, True) for i in range(12)}
    none = neargraph.near_duplicates(table(spark, [(None, v, 1), (1, v, 1)])).collect()
    assert {(r["vec_id"], r["component_id"], r["kept"]) for r in none} == {(None, None, False), (1, 1, True)}
    assert neargraph.near_duplicates(table(spark, [])).collect() == []


def sparse(seed=3, n=400):
    """Far vectors, two pairs of near ones and no others."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 32))
    x[7], x[11] = x[200] + 0.01, x[300] - 0.01
    return [(i, v.tolist(), 1) for i, v in enumerate(x)]


def lossy(keep):
    """Links of the graph, without those of the nodes that ``keep`` rejects."""
    whole = neargraph._links
    return lambda nodes, overlap: whole(nodes, overlap).where(keep)


def test_lost_links_are_made_good(spark, monkeypatch):
    rows = sparse()
    monkeypatch.setattr(neargraph, "_links", lossy("id < 0"))
    monkeypatch.setattr(neargraph, "PART_ROWS", 90)
    assert result(neargraph.near_duplicates(table(spark, rows))) == brute(rows)
    monkeypatch.setattr(neargraph, "MOST_AUDIT", 100)  # too few queries to tell
    assert result(neargraph.near_duplicates(table(spark, rows))) == brute(rows)


def test_a_dense_group_does_not_hide_small_ones(spark):
    rng = np.random.default_rng(5)
    centre, far = rng.normal(size=32), rng.normal(size=(60, 32))
    x = [*(centre + rng.normal(size=(600, 32)) * 0.02), *far, *(far + 0.005)]
    nodes = neargraph.nodes_of(table(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)]))
    found = spark.createDataFrame([(i, 599 if i < 600 else 0) for i in range(len(x))], "id long, linked long")
    assert neargraph.audit(nodes, found) < neargraph.LEAST_RECALL


def test_pairs_of_several_shards_count_in_the_first():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 32))
    x[151] = x[33] + 0.01
    frame = neargraph.pd.DataFrame({"id": range(200), "embedding": x.tolist(), "n": 1, "shard": 0, "shards": [[0, 1]] * 200, "parts": 1, "part": 0, "neighbours": [np.empty(0, int)] * 200})
    out = neargraph._search_shard(None, frame)
    assert out.groupby("id")["linked"].sum().loc[[33, 151, 50]].tolist() == [1, 1, 0]
    assert neargraph._search_shard(None, frame.assign(shard=1))["linked"].sum() == 0
