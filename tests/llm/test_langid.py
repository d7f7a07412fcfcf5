import numpy as np
import pyarrow.parquet as pq
from conftest_llm import ODD

from sylva.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = queries.op9_language_id(spark, SF).toPandas().set_index("doc_id")
    truth = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "lang"]).to_pandas().set_index("doc_id")["lang"]
    held = got[got["held_out"]]
    assert 0.15 < len(held) / len(got) < 0.35
    assert (held["lang_pred"] == truth[held.index]).mean() > 0.98
    assert got["score"].between(0, 1).all()


def test_codes_are_apart():
    for n in (2, 3, 5, 9, 40):
        code = langid.codewords(n).astype(int)
        assert min(((code[a] != code[b]).sum() for a in range(n) for b in range(a)), default=1) >= (1 if n < 3 else 2)


def test_codes_correct_a_wrong_bit():
    code = langid.codewords(9).astype(float)
    for k in range(9):
        margin = 2 * code[k]
        margin[k] *= -1
        loss = np.logaddexp(0, -margin * code).sum(1)
        assert loss.argmin() == k


def test_features_see_the_whole_text():
    a, b = "x" * 200_000 + " der die und", "x" * 200_000 + " the of and"
    assert not np.allclose(langid.features(a), langid.features(b))
    assert langid.features("12 !") is None and langid.features(None) is None


def test_odd_rows(spark, docs):
    words = {"en": "the of and with", "de": "der die und mit"}
    rows = [(i, f"{words['en' if i % 2 else 'de']} {i}", "en" if i % 2 else "de") for i in range(60)] + [(100 + i, t, None) for i, t in enumerate(ODD)] + [(None, "the of", "en")]
    frame = docs(*rows)
    model = langid.fit(frame)
    assert model.languages == ["de", "en"]
    got = langid.predict(frame, model).select("row.doc_id", "lang_pred", "score", "ambiguous").collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[100]["lang_pred"] == by[103]["lang_pred"] == "und" and by[1]["lang_pred"] == "en" and by[2]["lang_pred"] == "de"
    none = langid.fit(docs())
    assert {r["lang_pred"] for r in langid.predict(frame, none).collect()} == {"und"}
    one = langid.fit(docs((1, "the of", "en")))
    assert langid.predict(docs((2, "abc")), one).first()["lang_pred"] == "en"
    assert langid.predict(docs(), model).collect() == []


def test_every_label_is_learned(docs):
    rng = np.random.default_rng(2)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(5)] for _ in range(150)]
    text = lambda k: " ".join(rng.choice(words[k], 20))
    rows = [(1000 * k + i, text(k), f"t{k:03}") for k in range(150) for i in range(3 if k < 25 else 6)]
    frame = docs(*rows)
    model = langid.fit(frame)
    assert model.languages == [f"t{k:03}" for k in range(150)]
    fresh = docs(*[(k, text(k)) for k in range(150)])
    got = {r["doc_id"]: r for r in langid.predict(fresh, model).select("row.doc_id", "lang_pred", "ambiguous").collect()}
    assert sum(got[k]["lang_pred"] == f"t{k:03}" for k in range(25)) >= 24
    assert sum(got[k]["lang_pred"] == f"t{k:03}" for k in range(150)) >= 147 and sum(r["ambiguous"] for r in got.values()) <= 3


def test_many_codes_differ():
    code = langid.codewords(3000)
    assert len(np.unique(code, axis=0)) == 3000


def plain_features(text):
    """Grams of the cleaned text in plain Python, counted at their hashed places."""
    mask = 0xFFFFFFFF
    low = text.lower()
    codes = [32] + [ord(c) if c.isalpha() else 32 for k, c in enumerate(low) if c.isalpha() or not k or low[k - 1].isalpha()]
    c = [x * 2654435761 & mask for x in codes]
    pair = [(a >> 3) ^ (b * 40503 & mask) for a, b in zip(c, c[1:])]
    triple = [(a >> 2) ^ (b * 2246822519 & mask) for a, b in zip(pair, c[2:])]
    counts = np.zeros(langid.DIM)
    for gram in [*c[1:], *pair, *triple]:
        counts[(gram * 3266489917 & mask) >> 20] += 1
    return np.sqrt(counts) / np.sqrt(counts.sum())


def test_features_do_not_hang_on_where_stretches_are_cut():
    rng = np.random.default_rng(4)
    for n in (5, 300, (1 << 16) - 1, 1 << 16, (1 << 16) + 1, (1 << 17) + 7):
        text = "".join(rng.choice(list("abcé ,1\nZ"), n)) + "x"
        assert np.allclose(langid.features(text), plain_features(text), atol=1e-6), n


def test_decoding_is_that_of_all_codewords_compared_in_turn(spark, docs):
    """Brute force: each codeword's weighted logistic loss, bit by bit."""
    frame = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(frame.where(~langid.held_out()))
    got = langid.predict(frame, model).select("row.doc_id", "row.text", "lang_pred", "score", "ambiguous").collect()
    assert len(got) == frame.count()
    for r in got:
        x = plain_features(r["text"]) if r["text"] and any(c.isalpha() for c in r["text"]) else None
        if x is None:
            assert (r["lang_pred"], r["score"], r["ambiguous"]) == ("und", 0.0, True)
            continue
        losses = []
        for word in model.code:
            margins = [float(x @ model.weights[:, b]) + float(model.bias[b]) for b in range(len(word))]
            losses.append(sum(float(t) * np.log1p(np.exp(-m * int(w))) for m, w, t in zip(margins, word, model.trust)))
        chance = 1 / sum(np.exp(min(losses) - v) for v in losses)
        assert r["lang_pred"] == model.languages[int(np.argmin(losses))] and abs(r["score"] - chance) < 1e-4


def test_a_repeated_id_teaches_one_text(docs):
    rows = [(1, "the of and with", "en")] * 50 + [(1, "another text altogether", "en"), (2, "der die und", "de")]
    once = langid.fit(docs(*rows))
    again = langid.fit(docs(*rows[::-1]).repartition(7))
    assert np.array_equal(once.weights, again.weights) and once.languages == ["de", "en"]


def test_any_column_names(spark):
    frame = spark.createDataFrame([(1, "the of", "en", 5, 6)], "doc_id long, text string, lang string, `a.b` int, `c``d` int")
    out = langid.predict(frame, langid.fit(frame))
    assert out.select("row.*").columns == frame.columns and out.first()["row"]["a.b"] == 5
