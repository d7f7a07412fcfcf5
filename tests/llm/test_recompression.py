import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import ODD

from sylva.llm import recompression


def brute(rows):
    """kept words of each row by comparing all windows."""
    first = {}
    cut = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in cut:
        for p in range(len(w) - 12) if i is not None else ():
            key = tuple(w[p : p + 13])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in cut:
        gone = set()
        for p in range(len(w) - 12) if i is not None else ():
            if first[tuple(w[p : p + 13])] < i:
                gone |= set(range(p, p + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("seed", "vocabulary"), [(1, 2), (2, 6), (3, 500)])
def test_against_brute_force(docs, seed, vocabulary):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passages = [[word() for _ in range(rng.choice([12, 13, 14, 30, 80]))] for _ in range(8)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += [word() for _ in range(rng.randint(0, 25))] + (rng.choice(passages) if rng.random() < 0.6 else [])
        text += [word()] * rng.choice([0, 0, 0, 5, 40])
        rows.append((i, " ".join(text)))
    rows += [(200 + k, rows[k][1]) for k in range(0, 30, 2)] + [(300 + k, rows[3][1]) for k in range(20)]
    assert result(recompression.dedup(docs(*rows))) == brute(rows)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(5)
    for vocabulary in (1, 2, 3, 30):
        texts = [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(200)) for _ in range(20)]
        texts += [" ".join(t.split()[k : k + 60]) for t in texts for k in (0, 37, 140)]
        words, names, starts = recompression.name_words(texts)
        where, found = recompression.anchors(names, starts)
        flat, seen = [w for own in words for w in own], {}
        for p, a in zip(where, found):
            assert seen.setdefault(tuple(flat[p : p + 13]), a) == a
        assert len(where) == sum(max(0, len(w) - 12) for w in words)


def test_anchors_are_few():
    rng = random.Random(6)
    _, names, starts = recompression.name_words([" ".join(f"w{rng.randrange(5000)}" for _ in range(20000))])
    where, found = recompression.anchors(names, starts)
    assert len(np.unique(found)) < 0.4 * len(where)


def test_odd_rows(docs):
    long = " ".join(map(str, range(40)))
    rows = [*enumerate(ODD), (None, long), (50, long), (51, long), (51, long), (51, long + " x"), (49, "a b " + long)]
    rows = [r for r in rows if r[0] != 50]
    got = result(recompression.dedup(docs(*rows)))
    assert len(got) == len(rows) and got == brute(rows)
    assert recompression.dedup(docs()).collect() == []


def test_names_of_words_that_collide_change_nothing(spark):
    """Word names of two bits only: whole windows of different words then share all their symbols. The operator runs in
    the workers, so the names are forced there by way of a function of its own module."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(40)}"
    passages = [[word() for _ in range(30)] for _ in range(4)]
    rows = [(i, " ".join([word() for _ in range(rng.randint(0, 30))] + rng.choice(passages) + [word() for _ in range(20)])) for i in range(60)]
    real = recompression.NAME
    recompression.NAME = lambda w: len(w) & 1
    try:
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([0] * len(rows)), pa.array([t for _, t in rows])], ["doc_id", "key", "text"])
        named = [x for b in recompression._emit_anchors([batch]) for x in b.to_pylist()]
        by = {}
        for x in named:
            by.setdefault(x["doc_id"], []).append(x["anchor"])
        suspected = batch.append_column("anchors", pa.array([by.get(i, []) for i, _ in rows], pa.list_(pa.int64())))
        where, anchor = recompression.anchors(*recompression.name_words([t for _, t in rows])[1:])
        flat = [w for _, t in rows for w in t.split()]
        behind = {}
        for p, a in zip(where, anchor):
            behind.setdefault(a, set()).add(tuple(flat[p : p + 13]))
        assert sum(len(x) > 1 for x in behind.values()) > len(behind) / 2  # anchors that stand for windows of different words
        windows = [x for b in recompression._emit_windows([suspected]) for x in b.to_pylist()]
    finally:
        recompression.NAME = real
    first = {}
    for x in windows:
        first[x["a"], x["b"]] = min(first.get((x["a"], x["b"]), x["doc_id"]), x["doc_id"])
    gone = {}
    for x in windows:
        if first[x["a"], x["b"]] < x["doc_id"]:
            gone.setdefault(x["doc_id"], set()).update(range(x["place"], x["place"] + 13))
    assert [(i, len(gone.get(i, ()))) for i, _ in rows] == [(i, n) for i, _, n, _ in sorted(brute(rows))]


def test_window_names_are_of_the_words():
    words = [b"a", b"bc", b"d"] * 9
    name = recompression.window_names(words, np.array([0, 1, 3]))
    assert name[:16] == name[32:] == hashlib.sha256(b" ".join(words[:13])).digest()[:16] != name[16:32]
