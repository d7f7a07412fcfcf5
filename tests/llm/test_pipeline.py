import hashlib
import re
from collections import Counter

import pytest
from conftest_llm import ODD
from test_langid import plain_features
from test_mixing import plain_targets
from test_secrets import plain_base, plain_probability
from test_simhash import brute, plain_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from sylva.llm import bpe, langid, secrets

SF = "/root/testdata/sf0.001"


def plain_language(model, text):
    """Whether the text stays: it has letters and one codeword is plainly the nearest."""
    import numpy as np

    if not text or not any(c.isalpha() for c in text):
        return False
    margin = plain_features(text) @ model.weights + model.bias
    losses = [sum(float(t) * np.log1p(np.exp(-float(m) * int(w))) for m, w, t in zip(margin, word, model.trust)) for word in model.code]
    return 1 / sum(np.exp(min(losses) - v) for v in losses) >= langid.AMBIGUOUS


def plain_redacted(model, text):
    base = plain_base(text)
    runs = [m.span() for m in re.finditer(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{20,}", text)]
    runs = [(s, e) for s, e in runs if any(c.isalpha() for c in text[s:e]) and any(c.isdigit() for c in text[s:e])]
    own = [(s, 3, e) for s, e in runs if not any(a <= s and e <= b for a, _, b in base) and plain_probability(model, text, s, e) >= model.threshold]
    out, upto = "", 0
    for s, k, e in sorted(base + own):
        if s >= upto:
            out += text[upto:s] + f"<{secrets.KINDS[k]}>"
        upto = max(upto, e)
    return out + text[upto:]


def plain_mixture(rows):
    """``(doc_id, text)`` as often as the running sum of expected copies crosses an integer with it."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for _, text, source in rows:
        total[source] += size(text)
    target = plain_targets(dict(total))
    out = []
    for source in total:
        start = int(hashlib.md5(f"mix:{source or ''}".encode()).hexdigest()[:8], 16) >> 8
        rate = round(target[source] / total[source] * (1 << 24)) if total[source] else 0
        own = sorted((size(t), i, t) for i, t, s in rows if s == source)
        for k, (_, i, t) in enumerate(own):
            out += [(i, t)] * ((start + rate * (k + 1) >> 24) - (start + rate * k >> 24))
    return out


@pytest.mark.parametrize("lang", ["lang", "cast(null as string)"])
def test_against_a_plain_single_machine_version(spark, tmp_path, lang):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", f"{lang} as lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = Counter(tuple(r) for r in out.collect())

    rows = sorted((r["doc_id"], r["text"], r["source"]) for r in docs.collect())
    model, network = langid.fit(docs.where(~langid.held_out())), secrets.trained()
    rows = [r for r in rows if (plain_language(model, r[1]) if model.languages else r[1] and any(c.isalpha() for c in r[1]))]
    groups = brute([plain_fingerprint(t) for _, t, _ in rows])
    rows = [r for k, r in enumerate(rows) if groups[k] == k]
    rows = [(i, plain_redacted(network, t), s) for i, t, s in rows]
    library = Tokenizer.from_file(bpe.default_vocabulary())
    want = Counter()
    for i, text in plain_mixture(rows):
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())] += 1
    assert got == want and len(want) > 150


def test_extra_columns_of_any_name(spark):
    rows = [(k, f"the of and with number {k % 5} of that kind " * 3, "en", "s", 1, "x", "y", 1) for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, later string, `a.b` string, component_id int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, "")
        assert out.columns == frame.columns, name
        assert {r["later"] for r in out.collect()} == {"x"}, name


def test_decisions_take_effect(spark, docs):
    words = {"en": "the of and with that was", "de": "der die und mit das von"}
    base = [(i, f"{words['en' if i % 2 else 'de']} number {i} " * 4, "en" if i % 2 else "de", f"s{i % 3}") for i in range(60)]
    frame = docs(*base, (100, base[7][1], "en", "s1"), (101, "12 34 !!", None, "s0"), (102, 'the of token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and with that', "en", "s2"))
    kept = corpus_pipeline.language(spark, frame, "")
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == set(range(60)) | {100, 102}
    alone = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, kept, "").collect()}
    assert 7 in alone and 100 not in alone
    redacted = {r["doc_id"]: r["text"] for r in corpus_pipeline.secret_redaction(spark, kept, "").collect()}
    assert "04dbebab" not in redacted[102] and redacted[3] == base[3][1]
    mixed = corpus_pipeline.mixture(spark, kept, "")
    assert mixed.columns == frame.columns and mixed.count() > 62


def test_odd_rows_pass_through(spark, docs):
    frame = docs(*enumerate(ODD), (None, "the of and"), (1, ""))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for df in (frame, frame.limit(0)):
            out = stage(spark, df, "")
            out.collect()
            assert out.columns == frame.columns if k < 4 else "n_tokens" in out.columns, name


def test_no_label_to_learn_from_keeps_the_texts(spark, docs):
    frame = docs((0, "the of and"), (1, "der die und"), (2, "12 34 !!"), (3, None), (4, ""), (None, "no id"))
    kept = corpus_pipeline.language(spark, frame, "")
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {0, 1, None}
