"""Language identification by error-correcting output codes.

Each language gets a codeword of bits; for every bit a binary classifier over hashed character n-grams is trained to
tell the languages that have it from those that do not. A text is decoded to the language whose codeword costs the
classifiers' margins least, each bit's logistic loss weighing as much as its classifier is reliable on held-back
rows. Redundant bits let a few classifiers err. The score is the softmax of the negative losses; a text whose two
best codewords are nearly as good is flagged ambiguous.

Features of whole texts are computed on the executors, in training too: the driver only gets fixed-size vectors of at
most ``SAMPLE_PER_LANGUAGE`` texts per language, a documented bound; every label is learned. The model (some 100 KB) goes to the executors in
the function's closure.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, whole_row

#: Labelled texts per language that the classifiers are fitted on; the choice is by hash, the same at every size.
SAMPLE_PER_LANGUAGE = 400
#: Labelled texts of all languages together at most (16 KB of features each reach the driver); a text of each language
#: where there are more languages than that.
MOST_ROWS = 8000
#: Languages up to which the best spread of codes is searched for; more of them take codes that only differ.
SPREAD = 512
DIM, STEPS, RATE, DECAY = 1 << 12, 160, 0.5, 1e-4
UNKNOWN, AMBIGUOUS = "und", 0.5


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features(text: str | None) -> np.ndarray | None:
    """Hashed 1- to 3-grams of the lower-cased letters, other runs being one blank: square roots of counts, at unit
    length. None without any letter. Computed over the whole text, in stretches of 64k characters that hand their last two
    codes on, so that the cuts change nothing."""
    if not text:
        return None
    counts = np.zeros(DIM, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    found, before, tail = False, True, np.array([32], np.uint32)
    for at in range(0, len(points), 1 << 16):
        own = points[at : at + (1 << 16)]
        letter = _letters()[own]
        found |= bool(letter.any())
        kept = letter | np.concatenate([[before], letter[:-1]])
        before, old = bool(letter[-1]), len(tail)
        codes = np.concatenate([tail, np.where(letter, own, 32)[kept].astype(np.uint32)])
        tail = codes[-2:]
        c = codes * np.uint32(2654435761)
        pair = (c[:-1] >> 3) ^ (c[1:] * np.uint32(40503))
        triple = (pair[:-1] >> 2) ^ (c[2:] * np.uint32(2246822519))
        # Grams that end in the tail were counted with the stretch before.
        for grams in (c[old:], pair[old - 1 :], triple[max(0, old - 2) :]):
            counts += np.bincount((grams * np.uint32(3266489917)) >> np.uint32(20), minlength=DIM)
    if not found:
        return None
    x = np.sqrt(counts, dtype=np.float32)
    return x / np.float32(np.linalg.norm(x))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of -1/+1: the exhaustive code up to 5 languages, else the best spread of 64 random codes (beyond SPREAD
    languages a random one without repeats)."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        columns = [[1] + [1 if k >> (n - 2 - r) & 1 else -1 for r in range(n - 1)] for k in range(2 ** (n - 1) - 1)]
        return np.array(columns, np.int8).T
    bits, rng = 15 + 5 * int(np.ceil(np.log2(n))), np.random.default_rng(seed)
    while n > SPREAD:
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        if len(np.unique(code, axis=0)) == n:
            return code
    best, gap = None, -1
    for _ in range(64):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        apart = (bits - code.astype(int) @ code.T) // 2 + bits * np.eye(n, dtype=int)
        if apart.min() > gap:
            best, gap = code, apart.min()
    return best


class EcocModel:
    """Fitted on feature rows and language names; ``predict`` takes texts."""

    def __init__(self, x: np.ndarray, names: np.ndarray):
        self.languages = sorted(set(names))
        self.code = codewords(len(self.languages))
        y = self.code[np.searchsorted(self.languages, names)] if len(names) else np.empty((0, 1))
        self.weights = np.zeros((DIM, self.code.shape[1]), np.float32)
        self.bias, self.trust = np.zeros(self.code.shape[1], np.float32), np.ones(self.code.shape[1], np.float32)
        if len(self.languages) < 2:
            return
        # Held back by place within the language, so that one with few texts is not left without any.
        order = np.argsort(names, kind="stable")
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x)) - np.searchsorted(np.asarray(names)[order], np.asarray(names)[order])
        held = place % 5 == 4
        self._fit(x[~held], y[~held].astype(np.float32))
        right = ((x[held] @ self.weights + self.bias) * y[held] > 0).mean(0) if held.any() else np.ones(self.code.shape[1])
        self.trust = np.clip(2 * right - 1, 0.05, 1).astype(np.float32)

    def _fit(self, x, y):
        """Logistic loss, balanced by language group size on either side of the bit, by accelerated gradient steps."""
        share = np.where(y > 0, 0.5 / np.maximum((y > 0).sum(0), 1), 0.5 / np.maximum((y < 0).sum(0), 1)).astype(np.float32)
        v = np.zeros_like(self.weights)
        for k in range(STEPS):
            look = self.weights + 0.9 * v
            pull = y * share / (1 + np.exp(np.clip(y * (x @ look + self.bias), -30, 30)))
            v = 0.9 * v + RATE * 8 * (x.T @ pull - DECAY * look)
            self.weights = self.weights + v
            self.bias = self.bias + RATE * pull.sum(0)

    def predict(self, texts) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text."""
        rows = [features(t) for t in texts]
        known = np.array([r is not None for r in rows], bool) & bool(self.languages)
        names, score, unsure = [UNKNOWN] * len(rows), np.zeros(len(rows)), np.ones(len(rows), bool)
        if known.any():
            margin = np.stack([r for r, k in zip(rows, known) if k]) @ self.weights + self.bias
            # log(1 + e^m) is m more than log(1 + e^-m): what a codeword costs beyond that of all ones.
            loss = (np.logaddexp(0, -margin) * self.trust).sum(1, keepdims=True) + (margin * self.trust) @ ((1 - self.code.T) / 2)
            chance = np.exp(loss.min(1, keepdims=True) - loss)
            chance /= chance.sum(1, keepdims=True)
            best = loss.argmin(1)
            score[known] = chance.max(1)
            unsure[known] = chance.max(1) < AMBIGUOUS
            for i, k in zip(np.flatnonzero(known), best):
                names[i] = self.languages[k]
        return names, score, unsure


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limit: int = SAMPLE_PER_LANGUAGE) -> EcocModel:
    """A model of the languages of ``docs``, from ``limit`` texts each (lowest hash of the id); rows without id, text, lang
    or letters teach nothing, and an id teaches a language one text only, whatever is repeated. Long texts count whole. An
    empty table gives a model without languages. Only the labels are read to choose the rows, and the cut is made before
    the shuffle; of the rows drawn one text for each id comes to the driver, as a vector."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    # Eight times the rows wanted (of eight at least), by hash: so few that ranking them is cheap for a language of any size.
    found = labelled.groupBy(lang_col).count().collect()
    limit = min(limit, max(1, MOST_ROWS // max(1, len(found))))
    counts = docs.sparkSession.createDataFrame([(r[lang_col], 8.0 * max(limit, 8) / r["count"]) for r in found], "lang string, share double")
    first = Window.partitionBy("lang").orderBy("h", "id")
    drawn = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h")).join(F.broadcast(counts), "lang")
    drawn = drawn.where(F.shiftrightunsigned("h", 11) / float(1 << 53) < F.col("share")).select("id", "lang", "h").distinct()
    picked = drawn.withColumn("n", F.row_number().over(first)).where(F.col("n") <= limit).select("id", "lang")
    texts = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(F.broadcast(picked), ["id", "lang"])
    # One text for each id and language, however often they are repeated: that of the lowest hash.
    texts = texts.groupBy("id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("id", "lang", "x.text")

    def work(batches):
        for b in batches:
            rows = [features(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([None if r is None else r.tobytes() for r in rows], pa.binary())], ["id", "lang", "x"])

    got = texts.select("id", "lang", "text").mapInArrow(work, f"id {dict(texts.dtypes)['id']}, lang string, x binary").where("x is not null").toPandas()
    got = got.sort_values(["lang", "id"], kind="stable").reset_index(drop=True)
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, DIM)
    return EcocModel(x, got["lang"].to_numpy())


def predict(docs: DataFrame, model: EcocModel, text_col: str = "text") -> DataFrame:
    """``row`` (the row of docs as a struct, whatever its columns are called), ``lang_pred, score, ambiguous``. A null text
    and one without letters are ``und``, score 0; so is everything under a model that learned no language. Repeated rows
    are each returned; of codewords that cost the same the first language by code point wins, and the text is ambiguous."""

    def work(batches):
        for b in batches:
            names, score, unsure = [], [], []
            for at in range(0, len(b), 512):
                n, s, u = model.predict(b.column(1).slice(at, 512).to_pylist())
                names, score, unsure = names + n, score + [s], unsure + [u]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(np.concatenate(score or [[]]), pa.float64()), pa.array(np.concatenate(unsure or [[]]).astype(bool))], names=["row", "lang_pred", "score", "ambiguous"])

    small_batches(docs.sparkSession)
    source = docs.select(whole_row(docs).alias("row"), F.col(text_col).alias("_text"))
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    return source.mapInArrow(work, T.StructType([source.schema["row"], *added]))
