import random

from conftest_llm import ODD
from pyspark.sql import functions as F

from sylva.llm import mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Water filling by rounds: whoever is above its cap stops there, the rest is shared again."""
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    w = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    open_, fixed = set(names), {}
    while open_:
        left = share * sum(sizes.values()) - sum(fixed.values())
        total = sum(w[n] for n in open_)
        over = {n for n in open_ if left * w[n] / total > cap * sizes[n]}
        if not over:
            return fixed | {n: left * w[n] / total for n in open_}
        fixed |= {n: cap * sizes[n] for n in over}
        open_ -= over
    return fixed


def test_targets_and_taken(docs):
    rng = random.Random(1)
    sources = ["b", "a", "é", "c", None, "Z", ""]
    rows = [(i, " ".join("w" for _ in range(rng.choice([1, 5, 40, 200]))), "en", s) for i in range(1500) for s in [sources[min(6, int(rng.expovariate(0.7)))]]]
    frame = docs(*rows)
    got = mixing.mix(frame).select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()
    assert len(got) == 1500
    sizes = {s: sum(len(t.split()) for _, t, _, q in rows if q == s) for s in {r[3] for r in rows}}
    want = plain_targets(sizes)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert own[0]["source_size"] == sizes[s] and abs(own[0]["target"] - want[s]) < 1e-6 * want[s]
        taken = sum(r["copies"] * r["size"] for r in own)
        assert abs(taken - want[s]) <= 401, (s, taken, want[s])
        assert max(r["copies"] for r in own) <= 2
    again = mixing.mix(frame.repartition(7)).select("row.doc_id", "copies").collect()
    assert {(r["doc_id"], r["copies"]) for r in again} == {(r["doc_id"], r["copies"]) for r in got}


def test_emit_repeats_rows_with_their_columns(docs):
    frame = docs(*[(i, "a b c", "en", "one" if i % 3 else "two") for i in range(90)])
    out = mixing.emit(frame)
    assert out.columns == frame.columns
    n = out.groupBy("source").agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in n) in (134, 135, 136)


def test_emit_agrees_with_mix(docs):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.choice([1, 5, 40]))), None, rng.choice(["a", None, "b"])) for i in range(300)]
    frame = docs(*rows, *rows[:40], *rows[:40], (None, "x y", "en", "a"), (None, "x y", "de", "a"), (None, None, None, None))
    want = {(r["id"], r["text"], r["source"]): r["n"] for r in mixing.mix(frame).groupBy(F.col("row.doc_id").alias("id"), "row.text", "row.source").agg(F.sum("copies").alias("n")).where("n > 0").collect()}
    got = {(r["doc_id"], r["text"], r["source"]): r["n"] for r in mixing.emit(frame).groupBy("doc_id", "text", "source").agg(F.count("*").alias("n")).collect()}
    assert got == want and len(got) > 200


def test_odd_rows(docs):
    rows = [(i, t, None, "s" if i % 2 else None) for i, t in enumerate(ODD)] + [(None, "a b", None, "s"), (3, "x", None, "t"), (3, "x", None, "t")]
    got = mixing.mix(docs(*rows)).collect()
    assert len(got) == len(rows)
    assert {r["size"] for r in got if r["row"]["text"] in (None, "")} == {0}
    assert mixing.mix(docs()).collect() == []
    assert mixing.emit(docs()).collect() == [] and mixing.emit(docs(*rows)).columns == docs().columns
    silent = mixing.mix(docs((1, None), (2, ""))).collect()
    assert [(r["target"], r["copies"]) for r in silent] == [(0.0, 0)] * 2
