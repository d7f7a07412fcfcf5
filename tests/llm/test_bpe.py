import random

import pytest
from conftest_llm import ODD
from tokenizers import Tokenizer

from sylva.llm import bpe

PATH = bpe.default_vocabulary()
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.TrieEncoder(PATH)


def library(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return " ".join(map(str, ids)), LIBRARY.decode(ids, skip_special_tokens=False)


def test_odd_texts(encoder):
    assert list(encoder.encode_texts(ODD)) == [library(t) for t in ODD]


def test_random_texts(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_CHUNKS", 50)
    monkeypatch.setattr(bpe, "TOGETHER", 100)
    monkeypatch.setattr(bpe, "MEMO_PAIRS", 40)
    rng = random.Random(2)
    letters = "abcdeéñ'’ .,<|>tsréîç1²́中Σ\n\t 𝔸ﬀABC\x01\x85 "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    assert list(encoder.encode_texts(texts)) == [library(t) for t in texts]


def test_prefix_states_match_plain_merging(encoder):
    rng = random.Random(3)
    words = {"".join(rng.choice("theinganorstédu") for _ in range(rng.randint(1, 14))).encode().decode("latin-1").translate(encoder.shown) for _ in range(2000)}
    for w, tokens in encoder.encode_words(words).items():
        assert [encoder.names[n] for n in tokens] == encoder._merge([*w[:-1], w[-1] + bpe.END])


def test_words_are_solved_once_whatever_their_case_and_marks(monkeypatch):
    encoder, asked = bpe.TrieEncoder(PATH), []
    solve = encoder.encode_words
    monkeypatch.setattr(encoder, "encode_words", lambda words: asked.extend(words) or solve(words))
    texts = ["Zorblatt élanée", "ZORBLATT, (zorblatt) Élanée!", "zorblatt. élanée's zorblatt\tÉLANÉE", "中 zorblatt"]
    for t in texts:
        assert list(encoder.encode_texts([t])) == [library(t)]
    elan = "élanée".encode().decode("latin-1").translate(encoder.shown)
    assert asked.count("zorblatt") == asked.count(elan) == 1


def test_every_character_below_the_pattern_s_end(encoder):
    texts = [f"a{c}b{c}{c} {c}'re{c}s1{c} {c.lower()}\u0301" for c in map(chr, range(0x260)) if c != "\u0301"]
    assert list(encoder.encode_texts(texts)) == [library(t) for t in texts]
    plain = [t.replace("\u0301", "") for t in texts]
    assert list(encoder.encode_texts(plain)) == [library(t) for t in plain]


def test_tokens_stay_apart_as_plain_merging_says(encoder):
    rng = random.Random(5)
    inner = sorted((n for n in encoder.inner.values() if n >= 0), key=lambda n: (len(encoder.names[n]), n))
    final = sorted((n for n in encoder.final.values() if n >= 0), key=lambda n: (len(encoder.names[n]), n))
    pairs = [(rng.choice(inner[:upto]), rng.choice(kind[:upto])) for upto in (300, 3000, 30000) for kind in (inner, final) for _ in range(700)]
    pairs += [(a, b) for a in inner if len(set(encoder.names[a])) == 1 for b in inner if encoder.names[b][0] == encoder.names[a][0]][:2000]
    parts = {n: [*t[: -len(bpe.END) - 1], t[-len(bpe.END) - 1 :]] if (t := encoder.names[n]).endswith(bpe.END) else [*t] for n in {n for p in pairs for n in p}}
    want = [encoder._merge(parts[a] + parts[b]) == [encoder.names[a], encoder.names[b]] for a, b in pairs]
    assert encoder.orderly and [encoder._never_join(a, b) for a, b in pairs] == want and 0 < sum(want) < len(want)


def test_queries(spark, docs):
    import hashlib

    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (4, "a")]
    got = bpe.digests(docs(*rows), PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(enumerate(ODD)).get(r["doc_id"], "no id")
        ids, decoded = library(text)
        assert r["n_tokens"] == len(ids.split()) and r["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    whole = bpe.tokenise(docs((1, "it's a test"), (2, None)), PATH).orderBy("doc_id").collect()
    assert " ".join(map(str, whole[0]["ids"])) == library("it's a test")[0] and whole[1]["ids"] == [] and whole[1]["decoded"] == ""
    assert bpe.digests(docs(), PATH).collect() == []


def test_other_kinds_of_vocabularies_are_refused(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["end_of_word_suffix"] = None
    spec["normalizer"]["normalizers"].pop()
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="end_of_word_suffix, normalizer"):
        bpe.TrieEncoder(str(other))
