"""Substring dedup by recompression.

Adjacent symbols of every text are renamed level by level: first runs of one word become a symbol, then, in each of
``ROUNDS`` steps, a pair becomes a symbol when a coin tossed by name (and step) falls heads for its left and tails for
its right member. A name is a 64-bit hash of what it stands for, so naming is global: equal pairs get equal names in every
task without exchanging tables. Whether two symbols join depends on themselves alone, so equal stretches of text get equal
symbols but near their ends; each symbol carries the words its existence depends on, which makes "inside" exact.

Two Spark rounds then name and count over all texts, each carrying on only what two or more documents have:

1. Every window of ``WINDOW`` words is represented by its anchor, the longest symbol that the window's own words settle
   (ties: the larger name). Equal windows have equal anchors; neighbouring windows mostly share theirs, so texts give
   about a quarter as many distinct anchors as words. An anchor of one document rules all its windows out.
2. The windows behind shared anchors are verified by their words: each is named by SHA-256 (128 bits of it) of the words
   themselves, and the smallest document of each name is found. Names of words that collide so cost time, never a result.

Exact copies of a text are set aside first (every window of theirs is in the first copy), so a group of copies of any
size costs one row per copy. Aggregates combine on the map side and the joins back can split hot keys.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

WINDOW, ROUNDS = 13, 3
#: Words handled at once in numpy; texts are never split.
TOGETHER = 400_000
FAR = 1 << 40
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


#: The name of a word.
NAME = xxhash.xxh64_intdigest


def name_words(texts) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, their names one text after another, and where each text starts (and the last ends)."""
    words = [t.encode().split() if t else [] for t in texts]
    starts = np.cumsum([0, *map(len, words)])
    names = np.empty(starts[-1], np.uint64)
    for at, own in zip(starts, words):
        names[at : at + len(own)] = np.fromiter(map(NAME, own), np.uint64, len(own))
    return words, names, starts


def levels(names: np.ndarray, starts: np.ndarray):
    """Yields per level ``(name, words, from, upto)`` of its symbols: length in words and the stretch of words that
    settles the symbol (reaching FAR out where a text's end does)."""
    n = len(names)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    fresh = np.ones(n, bool)
    fresh[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
    s = np.flatnonzero(fresh)
    e = np.append(s[1:], n)
    name = np.where(e - s > 1, _mix(names[s] + U(0x632BE59BD9B4E019) * (e - s).astype(U)), names[s])
    text = text[s]
    low = np.where(s == starts[text], -FAR, s - 1)
    high = np.where(e == starts[text + 1], FAR, e + 1)
    for k in range(ROUNDS):
        if not len(name):
            return
        heads = (_mix(name + U(2 * k + 1)) >> U(63)).astype(bool)
        beside = text[1:] == text[:-1]
        joins = np.append(heads[:-1] & ~heads[1:] & beside, False)
        joined = np.append(False, joins[:-1])
        # A head that found no tail depends on what follows it, a tail without a head on what precedes.
        after = np.append(np.where(beside, high[1:], FAR), FAR)
        before = np.append(-FAR, np.where(beside, low[:-1], -FAR))
        high = np.where(heads, np.maximum(high, after), high)
        low = np.where(heads | joined, low, np.minimum(low, before))
        next_ = np.minimum(np.arange(len(name)) + 1, len(name) - 1)
        keep = ~joined
        name = np.where(joins, _mix(name * U(3) + _mix(name[next_] + U(0x9E3779B97F4A7C15))), name)[keep]
        e = np.where(joins, e[next_], e)[keep]
        high = np.where(joins, np.maximum(high, high[next_]), high)[keep]
        low = np.where(joins, np.minimum(low, low[next_]), low)[keep]
        s, text = s[keep], text[keep]
        yield name, e - s, low, high, starts[text]


def anchors(names: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Where windows start, and the anchor of each."""
    n = len(names)
    best = np.zeros(n, np.uint64)
    for name, words, low, high, first in levels(names, starts):
        fits = high - low <= window
        rank = (words[fits].astype(U) << U(58)) | (name[fits] >> U(6))
        low, at, first = low[fits], high[fits] - window, first[fits]
        for shift in range(window):
            ok = (at + shift <= low) & (at + shift >= first)
            np.maximum.at(best, at[ok] + shift, rank[ok])
    sizes = np.diff(starts)
    ends = np.repeat(starts[1:], sizes)
    is_window = np.arange(n) + window <= ends
    where = np.flatnonzero(is_window)
    bare = where[best[where] == 0]
    if len(bare):
        best[bare] = np.max([names[bare + k] >> U(6) for k in range(window)], axis=0) | (U(1) << U(58))
    return where, best[where]


def window_names(words: list[bytes], places: np.ndarray, window: int = WINDOW) -> bytes:
    """16 bytes for the window at each place: of the SHA-256 of its words, joined by one space."""
    text = b" ".join(words)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    return b"".join([hashlib.sha256(text[s : e - 1]).digest()[:16] for s, e in zip(at[places].tolist(), at[places + window].tolist())])


def _together(texts):
    """Slices of a batch's rows holding some TOGETHER words (a word has two bytes at least with its blank)."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        own = len(t or "") // 5
        if k > at and size + own > TOGETHER:
            yield at, k
            at, size = k, 0
        size += own
    if at < len(texts):
        yield at, len(texts)


def _emit_anchors(batches):
    for b in batches:
        texts = b.column(2).to_pylist()
        for at, upto in _together(texts):
            _, names, starts = name_words(texts[at:upto])
            where, found = anchors(names, starts)
            if not len(where):
                continue
            row = np.searchsorted(starts, where, "right") - 1
            new = np.ones(len(where), bool)
            new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
            row, found = row[new], found[new]
            order = np.lexsort((found, row))
            row, found = row[order], found[order]
            new = np.ones(len(row), bool)
            new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
            rows = pa.array(row[new] + at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(found[new].view(np.int64))], ["doc_id", "key", "anchor"])


def _emit_windows(batches):
    for b in batches:
        texts, shared = b.column(2).to_pylist(), b.column(3)
        for at, upto in _together(texts):
            words, names, starts = name_words(texts[at:upto])
            where, found = anchors(names, starts)
            row = np.searchsorted(starts, where, "right") - 1
            own = shared.slice(at, upto - at)
            of = np.repeat(np.arange(upto - at), own.value_lengths().to_numpy(zero_copy_only=False))
            known = own.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            hit = np.isin(found ^ _mix(row.astype(U)), known ^ _mix(of.astype(U)))
            where, row = where[hit], row[hit]
            place = where - starts[row]
            cut = np.searchsorted(row, np.arange(upto - at + 1))
            said = b"".join([window_names(own, place[i:j]) for own, i, j in zip(words, cut[:-1], cut[1:]) if i < j])
            name = np.frombuffer(said, np.int64).reshape(-1, 2)
            rows = pa.array(row + at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(place.astype(np.int32)), pa.array(name[:, 0]), pa.array(name[:, 1])], ["doc_id", "key", "place", "a", "b"])


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, key, places`` for rows with repeats of earlier texts: where the windows start that also start in a
    row with a smaller doc_id; null places for a whole copy of an earlier row's text. ``docs`` has doc_id, key (a hash
    of the text that tells rows with one id apart) and text."""
    slim = Scratch(docs.select("doc_id", "key", F.unhex(F.sha2("text", 256)).alias("sha")), "digests")
    shared = Scratch(slim.df.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("sha", "first"), "shared")
    copies = Scratch(slim.df.join(shared.df, "sha").where("doc_id > first").select("doc_id", "key").distinct(), "copies").df
    slim.drop()
    shared.drop()
    texts = docs.join(copies.hint("shuffle_hash"), ["doc_id", "key"], "left_anti").select("doc_id", "key", "text")

    named = Scratch(texts.mapInArrow(_emit_anchors, "doc_id long, key long, anchor long"), "anchors")
    # Shared names are written before they are joined back, so that only one shuffle of all names exists at a time.
    twice = Scratch(named.df.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "twice")
    suspects = Scratch(named.df.join(twice.df, "anchor").groupBy("doc_id", "key").agg(F.collect_list("anchor").alias("anchors")), "suspects")
    named.drop()
    twice.drop()

    suspected = docs.join(suspects.df.hint("shuffle_hash"), ["doc_id", "key"]).select("doc_id", "key", "text", "anchors")
    windows = Scratch(suspected.mapInArrow(_emit_windows, "doc_id long, key long, place int, a long, b long"), "windows")
    suspects.drop()
    first = Scratch(windows.df.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("a", "b", "first"), "first")
    later = windows.df.join(first.df, ["a", "b"]).where("doc_id > first")
    found = Scratch(later.groupBy("doc_id", "key").agg(F.collect_list("place").alias("places")), "repeats")
    windows.drop()
    first.drop()
    return found.df.unionByName(copies.withColumn("places", F.lit(None).cast("array<int>")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: ``doc_id, n_words, n_removed, kept`` (the words that stay, joined by one space) and
    its ``kept_sha256``.

    Null and empty texts have no words; texts under WINDOW words keep all; long ones are never split. Rows without an id
    lose nothing and take nothing from others. Rows of one id, whether their texts are equal or not, take nothing from one
    another, and each is returned. Only the two columns are read, so others cannot clash; no rows give none.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    found = repeats(base.where("doc_id is not null")).withColumn("hit", F.lit(True))
    both = base.join(found.hint("shuffle_hash"), ["doc_id", "key"], "left").select("doc_id", "text", "places", F.coalesce("hit", F.lit(False)).alias("hit"))

    def work(batches):
        for b in batches:
            out = []
            texts, hits = b.column(1), b.column(3).to_pylist()
            for k, text in enumerate(texts):
                words = text.as_py().encode().split()
                n, kept = len(words), words
                if hits[k] and n >= WINDOW:
                    if b.column(2)[k].is_valid:
                        edge = np.zeros(n + 1, np.int64)
                        places = np.unique(b.column(2)[k].values.to_numpy(zero_copy_only=False))
                        edge[places] += 1
                        np.subtract.at(edge, places + WINDOW, 1)
                        stay = np.cumsum(edge[:-1]) == 0
                        kept = [w for w, ok in zip(words, stay) if ok]
                    else:
                        kept = []
                joined = b" ".join(kept)
                out.append((n, n - len(kept), joined.decode(), hashlib.sha256(joined).hexdigest()))
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return both.mapInArrow(work, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
