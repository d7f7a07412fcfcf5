import hashlib
import random
import re

from conftest_llm import ODD

from sylva.llm import spotsigs


def plain_set(text):
    w = [x for x in re.split(r"[^\w]+|_", (text or "").lower()) if x]
    common = set(spotsigs.ANCHORS)
    sigs = []
    for k, x in enumerate(w):
        if x in common:
            if k + 1 == len(w):
                sigs.append((x,))
            elif w[k + 1] not in common:
                sigs.append((x, w[k + 1], *[y for y in w[k + 2 : k + 2 + spotsigs.REACH] if y not in common][:1]))
        elif not common & set(w[max(0, k - 2) : k]):
            sigs.append(tuple(w[k : k + 2]))
    return {hashlib.md5(" ".join(s).encode()).hexdigest()[: spotsigs.DIGITS] for s in sigs}


def alike(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b) if a and b else 0.0


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "und", "der"]) if rng.random() < 0.3 else f"w{rng.randrange(400)}" for _ in range(n))


def test_against_plain_python(docs):
    rng = random.Random(1)
    texts = [t for t in ODD if not t or len(t) < 1000] + [prose(rng, rng.choice([3, 23, 24, 60, 300])) for _ in range(40)]
    ids = list(range(0, 3 * len(texts), 3))
    got = {r["doc_id"]: r for r in spotsigs.compare_with_next(docs(*zip(ids, texts))).collect()}
    assert sorted(got) == ids
    for k, i in enumerate(ids):
        text, after = texts[k] or "", texts[(k + 1) % len(texts)] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = map(plain_set, (text, edited, after))
        assert (r["fingerprint"], r["edited_fingerprint"]) == ("".join(sorted(a)), "".join(sorted(b)))
        assert abs(r["near_edited"] - alike(a, b)) < 1e-12 and abs(r["near_next"] - alike(a, c)) < 1e-12


def test_odd_rows(docs):
    rows = [*enumerate(ODD), (None, "no id"), (4, "a"), (5, "other"), (5, "a b")]
    got = spotsigs.compare_with_next(docs(*rows)).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 1
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert len(by[4]) == 1 and len(by[5]) == 2
    (alone,) = spotsigs.compare_with_next(docs((1, "just one text"))).collect()
    assert alone["near_next"] == 1.0
    assert spotsigs.compare_with_next(docs()).collect() == []


def test_similar_pairs_against_brute_force(spark, docs):
    rng, rows = random.Random(4), []
    for _ in range(40):
        words = prose(rng, rng.choice([40, 120, 300])).split()
        for _ in range(rng.choice([1, 1, 3])):
            edited = list(words)
            for _ in range(rng.choice([0, 1, 3, 12])):
                edited[rng.randrange(len(edited))] = f"w{rng.randrange(400)}"
            rows.append((len(rows), " ".join(edited)))
    rows += [(1000, rows[0][1]), (1001, ""), (1002, None)]
    prints = spotsigs.with_fingerprint(docs(*rows).select("doc_id", "text"), "text", "fingerprint")
    sets = {}
    for i, t in rows:
        sets.setdefault(frozenset(plain_set(t)), i)
    want = {(min(i, j), max(i, j)) for a, i in sets.items() for b, j in sets.items() if i < j and a and b and alike(a, b) >= 0.8}
    got = {(r["a"], r["b"]) for r in spotsigs.similar(prints).collect()}
    assert got == want and want
    members = {r["doc_id"]: r["class_id"] for r in spotsigs.members_of(prints).collect()}
    assert members[1000] == 0 and members[1002] == 1001


def test_likeness_does_not_jump_with_length_or_the_first_anchor(docs):
    rng = random.Random(4)
    words = prose(rng, 24).split()
    plain = [f"w{rng.randrange(400)}" for _ in range(60)]
    texts = {0: " ".join(words), 1: " ".join(words[:23]), 2: " ".join(plain), 3: " ".join([*plain[:30], "the", *plain[30:]]), 4: "the", 5: "the word", 6: None}
    got = {r["doc_id"]: r for r in spotsigs.compare_with_next(docs(*texts.items())).collect()}
    assert got[0]["near_next"] > 0.7  # 24 and 23 words: a signature each way at the cut
    assert got[2]["near_next"] > 0.9  # no anchor and one
    assert all(got[k]["fingerprint"] for k in range(6)) and got[6]["fingerprint"] == ""
    assert all(got[k]["near_edited"] > 0.25 for k in (0, 1, 2, 3))  # a quarter of the text is another one
