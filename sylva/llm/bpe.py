"""BPE encoding and decoding by a prefix-sharing trie traversal.

In a byte-pair encoding the last token of a prefix settles the whole encoding of that prefix: it is the encoding of
the shorter prefix before that token, then the token. A token can end a prefix just when it and the last token of the
shorter prefix stay apart under the merges, and exactly one can. So the distinct words of a batch are laid out as a
trie in depth-first order (sorted, a stack holding the last tokens along the current path); each trie node is solved
once from nodes above it, and words with a common prefix share its states. Cost is linear in trie nodes, also for
words of any length.

Documents are independent, so there is no shuffle. Texts of Latin letters are cut into lower-cased words by one pattern,
others into chunks between white space, which the library's own steps may cut further. Solved words and chunks are
memoised in each Python worker; whenever there are ``MEMO_CHUNKS``, those that were not used since the last time are
forgotten. That bounds memory and never changes a result.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MEMO_CHUNKS = 200_000
#: Pairs of tokens remembered as staying apart or not; forgotten likewise when there are more.
MEMO_PAIRS = 600_000
END = "</w>"
#: Characters that the library's normaliser only lower-cases, one by one, and its splitter takes as the pattern below does.
LATIN = [c for c in map(chr, range(0x250)) if len(c.lower()) == 1 and c.lower() < "\u0250"]
OTHER = re.compile(f"[^{re.escape(''.join(LATIN))}]")
LETTERS, NUMBERS, SPACES = ("".join(c for c in LATIN if regex.match(kind, c)) for kind in (r"\p{L}", r"\p{N}", r"\s"))
PIECES = re.compile(f"[{LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
#: Characters whose words are solved together.
TOGETHER = 3_000_000


class TrieEncoder:
    """A word-end BPE vocabulary of the tokenizers library's JSON format, encoding by trie traversal.

    The format allows other normalisers, splitters and models than the one this follows (lower-cased words with a word-end
    mark, byte letters, unmerged special tokens without white space); a file with any of them raises ValueError."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._require(spec)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        # A chunk without any of these has no special token in it.
        self.marks = sorted({t[:2] for t in self.special})
        self.mark = self.marks[0] if len(self.marks) == 1 else None
        self.names = {v: k for k, v in (self.ids | self.special).items()}
        self.name = self.names.__getitem__
        library = Tokenizer.from_file(path)
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.shown = dict(enumerate(self._byte_letters()))
        inner = {t for t in self.ids if not t.endswith(END) and self._merge(list(t)) == [t]}
        final = {t[: -len(END)] for t in self.ids if t.endswith(END) and self._merge([*t[: -len(END) - 1], t[-len(END) - 1 :]]) == [t]}
        # Every tail of a token gives -1, a token itself its id.
        self.inner = {t[k:]: -1 for t in inner for k in range(1, len(t))} | {t: self.ids[t] for t in inner}
        self.final = {t[k:]: -1 for t in final for k in range(1, len(t))} | {t: self.ids[t + END] for t in final}
        self.length = {self.ids[t]: len(t) for t in inner} | {self.ids[t + END]: len(t) for t in final}
        self.apart: dict[int, bool] = {}
        # By pair of tokens the rank of their merge; by token its merge, where each has one and only merges of merges that
        # come before, as training leaves them.
        self.joins = {self.ids[a] << 20 | self.ids[b]: k for (a, b), k in self.rank.items()}
        self.made = {self.ids[a + b]: (k, self.ids[a], self.ids[b]) for (a, b), k in self.rank.items()}
        none = (-1, 0, 0)
        self.orderly = len(self.made) == len(self.rank) and all(max(self.made.get(a, none)[0], self.made.get(b, none)[0]) < k for k, a, b in self.made.values())
        # By chunk its ids and its decoded text, in two tables so that a text is put together without a loop.
        self.memo: tuple[dict[str, str], dict[str, str]] = {}, {}
        self.older: tuple[dict[str, str], dict[str, str]] = {}, {}
        self.said = {n: str(n) for n in self.ids.values()}.__getitem__

    @staticmethod
    def _require(spec: dict) -> None:
        model, cut = spec["model"], spec["pre_tokenizer"]
        parts = [x["type"] for x in cut.get("pretokenizers", [cut])]
        steps = [x["type"] for x in spec["normalizer"].get("normalizers", [spec["normalizer"]])]
        known = {
            "type": model["type"] == "BPE", "end_of_word_suffix": model.get("end_of_word_suffix") == END, "dropout": not model.get("dropout"),
            "continuing_subword_prefix": not model.get("continuing_subword_prefix"), "ignore_merges": not model.get("ignore_merges"),
            "normalizer": steps == ["NFC", "Replace", "Lowercase"], "pre_tokenizer": parts == ["Split", "ByteLevel"], "decoder": spec.get("decoder") is None,
            "added_tokens": all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not regex.search(r"\s", t["content"]) for t in spec["added_tokens"]),
        }
        if wrong := [k for k, ok in known.items() if not ok]:
            raise ValueError(f"not a vocabulary of this kind: {', '.join(wrong)}")

    @staticmethod
    def _byte_letters() -> list[str]:
        """The printable letter for each byte, as byte-level vocabularies define it: printable Latin-1 stands for
        itself, the others are numbered from 256 upward."""
        shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
        rest = iter(range(256, 512))
        return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]

    def _merge(self, parts: list[str]) -> list[str]:
        """The merges applied in order of rank; only for strings of at most two tokens' length."""
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda p: self.rank.get(p, 1 << 30))
            if best not in self.rank:
                break
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == best:
                    out.append(parts[k] + parts[k + 1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether the merges leave token a alone when token b follows."""
        if len(self.apart) >= MEMO_PAIRS:
            self.apart.clear()
        if self.orderly:
            ok = self._never_join(a, b)
        else:
            left, right = self.names[a], self.names[b]
            tail = [*right[: -len(END) - 1], right[-len(END) - 1 :]] if right.endswith(END) else [*right]
            ok = self._merge([*left, *tail]) == [left, right]
        self.apart[a << 20 | b] = ok
        return ok

    def _never_join(self, a: int, b: int) -> bool:
        """Undoes the merges of a and b, the latest first: they stay apart if what meets at their border never has a merge
        that comes before the next one undone (of equal ones the left comes first)."""
        joins, made, limit, none = self.joins, self.made, 1 << 30, (-1, 0, 0)
        of_a, of_b = made.get(a, none), made.get(b, none)
        while joins.get(a << 20 | b, limit) >= limit:
            if of_a[0] > of_b[0]:
                limit, a = of_a[0], of_a[2]
                of_a = made.get(a, none)
            elif of_b[0] >= 0:
                limit, b = of_b[0] + 1, of_b[1]
                of_b = made.get(b, none)
            else:
                return True
        return False

    def _last(self, word: str, end: int, before: list[int], tails: dict[str, int]) -> int:
        """The last token of word[:end]; before[k] is that of word[:k]."""
        for k in range(end - 1, -1, -1):
            n = tails.get(word[k:end])
            if n is None:
                break
            if n >= 0:
                if not k:
                    return n
                ok = self.apart.get(before[k] << 20 | n)
                if self._stay_apart(before[k], n) if ok is None else ok:
                    return n
        raise ValueError(f"the vocabulary has no token for the end of {word[:end][-20:]!r}")

    def encode_words(self, words) -> dict[str, list[int]]:
        """Token ids of each distinct word (in byte letters): the trie's depth-first traversal."""
        out: dict[str, list[int]] = {}
        inner, final, length, apart = self.inner, self.final, self.length, self.apart
        path, before, starts = "", [-1], [0]  # starts[k] is where the token before[k] begins
        for word in sorted(words):
            n = final.get(word, -1)
            if n >= 0:  # a token by itself
                out[word] = [n]
                continue
            shared = 0
            top = min(len(path), len(word) - 1)
            while shared < top and path[shared] == word[shared]:
                shared += 1
            del before[shared + 1 :], starts[shared + 1 :]
            k = starts[-1]
            for end in range(shared + 1, len(word)):
                # Most often the letter just extends the last token.
                n = inner.get(word[k:end], -1)
                if n < 0 or k and not apart.get(before[k] << 20 | n):
                    n = self._last(word, end, before, inner)
                    k = end - length[n]
                before.append(n)
                starts.append(k)
            path = word[: len(word) - 1]
            n = final.get(word[k:], -1)
            if n < 0 or not apart.get(before[k] << 20 | n):
                n = self._last(word, len(word), before, final)
                k = len(word) - length[n]
            tokens = [n]
            while k:
                tokens.append(before[k])
                k = starts[k]
            out[word] = tokens[::-1]
        return out

    def words_of(self, chunk: str) -> list[str]:
        """The words, in byte letters, of a text without special tokens. What is all letters needs no pattern."""
        if not chunk.isascii() and OTHER.search(chunk):
            return [w for w, _ in self.split(self.normalise(chunk))]
        low = chunk.lower()
        words = [low] if low.isalpha() else PIECES.findall(low)
        return words if low.isascii() and low.isprintable() else [w.encode().decode("latin-1").translate(self.shown) for w in words]

    def keys_of(self, text: str) -> list[str]:
        """What the memo knows a text by: its words, lower-cased, where that is all the library does to it; else its chunks.
        A word as a chunk is that word, so one memo serves both."""
        if (text.isascii() or not OTHER.search(text)) and not any(m in text for m in self.marks):
            return PIECES.findall(text.lower())
        return text.replace("\n", " ").split(" ")

    def solve(self, chunks) -> None:
        """Fills the memo for chunks (stretches of text between white space) and words: ids and decoded text of each."""
        special = {c for c in chunks if mark in c} if (mark := self.mark) else {c for c in chunks if any(m in c for m in self.marks)}
        cut = {c: self.words_of(c) for c in (chunks.difference(special) if special else chunks)}
        marked = {c: [[p] if p in self.special else self.words_of(p) for p in self.split_special.split(c)] for c in special}
        words = set().union(*cut.values(), *(p for parts in marked.values() for p in parts)).difference(self.special)
        out = {w: (" ".join(map(self.said, tokens)), self.decode(tokens)) for w, tokens in self.encode_words(words).items()}
        out |= {t: (str(n), self.decode([n])) for t, n in self.special.items()}
        ids, texts = self.memo
        for c, own in cut.items():
            if len(own) == 1:
                ids[c], texts[c] = out[own[0]]
            else:
                ids[c], texts[c] = " ".join([out[w][0] for w in own]), " ".join([out[w][1] for w in own])
        for c, parts in marked.items():
            own = [out[w] for p in parts for w in p]
            ids[c], texts[c] = " ".join([x[0] for x in own]), " ".join([x[1] for x in own])

    def decode(self, numbers) -> str:
        """The text of token ids; ids outside the vocabulary are left out. The format defines no decoder, so tokens
        stand as they are, joined by one space; so texts may be decoded piece by piece."""
        try:
            return " ".join(map(self.name, numbers))
        except KeyError:
            return " ".join([self.names[n] for n in numbers if n in self.names])

    def encode_texts(self, texts):
        """Yields per text (null: empty) its ids in decimal and its decoded text, each joined by one space."""
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and size < TOGETHER:
                size += len(texts[upto] or "")
                upto += 1
            cut = [self.keys_of(t) if t else [] for t in texts[at:upto]]
            chunks = set().union(*cut)
            ids, decoded = self.memo
            missing = chunks.difference(ids)
            again = [c for c in missing if c in self.older[0]]
            for c in again:
                ids[c], decoded[c] = self.older[0][c], self.older[1][c]
            missing.difference_update(again)
            if len(ids) + len(missing) > MEMO_CHUNKS:  # what is in use stays, the others are kept for one turn more
                kept = chunks.difference(missing)
                self.older, self.memo = self.memo, ({c: ids[c] for c in kept}, {c: decoded[c] for c in kept})
                ids, decoded = self.memo
            gc.disable()  # solving makes many lists and no cycles to look for
            try:
                self.solve(missing)
            finally:
                gc.enable()
            for own in cut:
                yield " ".join(filter(None, map(ids.__getitem__, own))), " ".join(filter(None, map(decoded.__getitem__, own)))
            at = upto


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
        gc.freeze()  # the vocabulary stays; no collection need look at it again
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _stretches(batches):
    """Ids and texts of some TOGETHER characters at a time, whatever the size of the Arrow batches they come in."""
    ids, texts, size = [], [], 0
    for b in batches:
        for at in range(0, len(b), 256):
            ids.append(b.column(0).slice(at, 256))
            texts += b.column(1).slice(at, 256).to_pylist()
            size += sum(len(t) for t in texts[-len(ids[-1]) :] if t)
            if size >= TOGETHER:
                yield pa.concat_arrays(ids), texts
                ids, texts, size = [], [], 0
    if ids:
        yield pa.concat_arrays(ids), texts


def tokenise(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>, decoded)`` of every row: the encoding and its decoding. Null texts are empty."""

    def work(batches):
        e = encoder(path)
        for own, texts in _stretches(batches):
            said = list(e.encode_texts(texts))
            ids = pa.array([[int(n) for n in x.split()] for x, _ in said], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([own, ids, pa.array([y for _, y in said], pa.string())], ["doc_id", "ids", "decoded"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, made where the text is read.

    Null and empty texts have no tokens and the digests of an empty string; repeated rows and ids are each returned. Long
    texts are encoded whole, also those of one word. Only the two columns are read, so others cannot clash; no rows give
    none.
    """

    def work(batches):
        e = encoder(path)
        for own, texts in _stretches(batches):
            n, a, d = [], [], []
            for x, y in e.encode_texts(texts):
                n.append(x.count(" ") + 1 if x else 0)
                a.append(hashlib.sha256(x.encode()).hexdigest())
                d.append(hashlib.sha256(y.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([own, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
