"""Secret scans: fixed patterns plus a character convolutional network over every candidate and its context.

Candidates are what the patterns find and every unbroken run of key characters with a letter and a digit in it. The
network (numpy, trained here) sees one-hot character classes of a candidate and the text around it: a convolution of
width 5, maximum and mean pooling, a logistic output. It is trained on labelled findings drawn by rule with a fixed seed
(keys, tokens and passwords against names, addresses, numbers, UUIDs, checksums, placeholders and repeated characters);
held-back findings calibrate its output (Platt scaling) and set the threshold: one that keeps ``RECALL`` of the labelled
secrets and otherwise stays far from the harmless ones. Each finding carries its calibrated probability. Pattern findings
stay whatever it is; the network adds spans of kind ``model`` among the candidates that no pattern covers whole. It sees a
candidate longer than its window piece by piece, and the most probable piece counts. Texts are scanned whole, row by row,
without any shuffle.
"""

from __future__ import annotations

import functools
import hashlib
import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# The pattern kinds in their listed order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")
KEYWORDS = re.compile(r"pass|secret|token|api", re.I | re.A)

#: What the network looks at beside the patterns' findings: unbroken runs of key characters of this length with a letter
#: and a digit in them.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{20,}")
LEFT, BODY, RIGHT, WIDTH, FILTERS = 24, 48, 8, 5, 16
FINDINGS, EPOCHS, RECALL, SEED = 4800, 12, 0.98, 11


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the pattern findings, sorted: leftmost and non-overlapping within each kind."""
    found = []
    if KEYWORDS.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str):
    """Spans of every run that may be a secret without any pattern saying so, in order and apart from one another."""
    for m in CANDIDATE.finditer(text):
        s = m.group()
        if not s.isalpha() and any(c.isalpha() for c in s) and any(c.isdigit() for c in s):
            yield m.span()


@functools.cache
def _classes() -> np.ndarray:
    """The class of each code point below 128: what the convolution can tell apart."""
    groups = ["aeiou", "bcdf", "ghjklmnpqrstvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "01234567", "89", "=", "/", "+", "-", "_", ".", ":", "\"'", " \n\t"]
    out = np.full(129, len(groups), np.int64)
    for k, g in enumerate(groups):
        out[[ord(c) for c in g]] = k
    return out


CHANNELS = 19


def window(text: str, start: int, end: int) -> np.ndarray:
    """Channels by position: character classes, whether inside the candidate, and padding. A candidate longer than
    BODY shows its head and its tail."""
    body = text[start:end]
    body = body if len(body) <= BODY else body[: BODY // 2] + body[-(BODY // 2) :]
    left, right = text[max(0, start - LEFT) : start], text[end : end + RIGHT]
    shown = left.rjust(LEFT, "\0") + (body + right).ljust(BODY + RIGHT, "\0")
    points = np.minimum(np.frombuffer(shown.encode("utf-32-le"), np.uint32), 128).astype(np.int64)
    x = np.zeros((len(shown), CHANNELS), np.float32)
    x[np.arange(len(shown)), np.where(points == 0, CHANNELS - 1, _classes()[points])] = 1
    x[LEFT : LEFT + len(body), CHANNELS - 2] = 1
    return x


def views(text: str, start: int, end: int):
    """The windows of a candidate: one, or for a longer one than BODY also those of pieces of that length, half a piece
    apart, up to its end, each as if it stood by itself behind what stands before the candidate."""
    yield window(text, start, end)
    if end - start > BODY:
        lead, rest = text[max(0, start - LEFT) : start], text[end : end + RIGHT]
        for at in [*range(start, end - BODY, BODY // 2), end - BODY]:
            yield window(lead + text[at : at + BODY] + rest, len(lead), len(lead) + BODY)


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """``(text, start, end, is secret)``, made by rule from a fixed seed, half of them secrets."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    lower, digits, upper = "abcdefghijklmnopqrstuvwxyz", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = lambda: "".join(rng.choice(["an", "the", "ti", "on", "er", "re", "st", "la", "de", "und", "que", "in", "ou"], rng.integers(1, 5)))
    mixed = lower + upper + digits
    dashed = lambda s, *cuts: "-".join(s[a:b] for a, b in zip((0, *cuts), (*cuts, len(s))))
    # What stands before a finding, by the kind of thing it is.
    bare, keyed, summed = [" ", " (", "\n", ' "', " id "], [" ", ' token = "', " key: ", " (", "\n", ' "', " auth=", " secret: "], [" sha1: ", " md5 ", " checksum=", ' etag: "', " digest "]
    assigned = [' password = "', " token: ", " secret=", " api_key='", " passwd: "]
    secrets = [
        (keyed, lambda: pick("0123456789abcdef", rng.integers(24, 65))),
        (keyed, lambda: pick(mixed + "+/", rng.integers(24, 64)) + rng.choice(["", "=", "=="])),
        (keyed, lambda: rng.choice(["sk_live_", "ghp_", "xoxb-", "pk-", "AIza"]) + pick(mixed, rng.integers(24, 40))),
        (keyed, lambda: "AKIA" + pick(upper + digits, 16)),
        (keyed, lambda: ".".join(["eyJ" + pick(mixed + "_-", rng.integers(17, 40)) for _ in range(3)])),
        (assigned, lambda: pick(mixed + "_-.", rng.integers(8, 20))),
    ]
    harmless = [
        (bare, lambda: "-".join(word() for _ in range(6)) + "-" + pick(digits, rng.integers(1, 4))),
        (bare, lambda: "/".join(word() for _ in range(5)) + f"/v{rng.integers(1, 99)}.{rng.choice(['html', 'txt', 'py', 'java'])}"),
        (bare, lambda: f"{word()}.{word()}{pick(digits, 2)}.{word()}.example.{rng.choice(['com', 'org', 'net'])}"),
        (bare, lambda: rng.choice(list("=-._")) * int(rng.integers(18, 50)) + word() + pick(digits, 2)),
        (bare, lambda: f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}_{word()}_{word()}_{pick(digits, 4)}"),
        (bare, lambda: "_".join(word() for _ in range(5)) + pick(digits, rng.integers(1, 3))),
        (bare, lambda: word() + word() + word() + word() + word() + pick(digits, rng.integers(1, 3))),
        (bare, lambda: dashed(pick("0123456789abcdef" if rng.random() < 0.7 else "0123456789ABCDEF", 32), 8, 12, 16, 20)),
        (summed, lambda: pick("0123456789abcdef" if rng.random() < 0.5 else "0123456789ABCDEF", rng.choice([32, 40, 64]))),
        (summed, lambda: pick(upper + "234567", 32)),
        (assigned, lambda: rng.choice(["changeme", "example", "xxxxxxxx", "your_token_here", "none", "placeholder", "password"]) + rng.choice(["", "1", "..."])),
    ]
    out = []
    for k in range(n):
        secret = k % 2 == 0
        known = secrets if secret else harmless
        before, make = known[int(rng.integers(len(known)))]
        body = str(make())
        lead = " ".join(word() for _ in range(5)) + str(rng.choice(before))
        out.append((f"{lead}{body} {word()} {word()}", len(lead), len(lead) + len(body), int(secret)))
    return out


class CharCnn:
    """Weights, a calibration (scale, shift) and a threshold on the calibrated probability."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.kernel = rng.normal(0, 0.2, (WIDTH * CHANNELS, FILTERS)).astype(np.float32)
        self.shift, self.out, self.bias = np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, 2 * FILTERS).astype(np.float32), np.float32(0)
        self.scale, self.offset, self.threshold = 1.0, 0.0, 0.5

    @staticmethod
    def _patches(x):
        return np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, WIDTH * CHANNELS)

    def _forward(self, p):
        a = np.maximum(p @ self.kernel + self.shift, 0)
        h = np.concatenate([a.max(1), a.mean(1)], axis=1)
        return a, h, h @ self.out + self.bias

    def fit(self, findings) -> CharCnn:
        """Adam on three quarters of the findings; the last quarter calibrates and sets the threshold."""
        x = np.stack([window(t, s, e) for t, s, e, _ in findings])
        y = np.array([k for *_, k in findings], np.float32)
        cut = len(x) * 3 // 4
        rng, state, t = np.random.default_rng(SEED), {}, 0
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(cut), max(1, cut // 128)):
                p = self._patches(x[at])
                a, h, z = self._forward(p)
                g = (1 / (1 + np.exp(-z)) - y[at]) / len(at)
                gh = g[:, None] * self.out
                ga = np.repeat(gh[:, None, FILTERS:] / a.shape[1], a.shape[1], axis=1)
                i, f = np.indices((len(at), FILTERS))
                ga[i, a.argmax(1), f] += gh[:, :FILTERS]
                ga *= a > 0
                t += 1
                grads = {"kernel": np.einsum("npk,npf->kf", p, ga, optimize=True), "shift": ga.sum((0, 1)), "out": h.T @ g, "bias": g.sum()}
                for name, grad in grads.items():
                    m, v = state.get(name, (0.0, 0.0))
                    m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
                    state[name] = m, v
                    setattr(self, name, (getattr(self, name) - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32))
        z, truth = self._forward(self._patches(x[cut:]))[2].astype(float), y[cut:].astype(float)
        for _ in range(200):
            p = 1 / (1 + np.exp(-(self.scale * z + self.offset)))
            self.scale -= 0.1 * float(((p - truth) * z).mean())
            self.offset -= 0.1 * float((p - truth).mean())
        p = 1 / (1 + np.exp(-(self.scale * z + self.offset)))
        kept, others = np.sort(p[truth > 0]), p[truth == 0]
        if len(kept):
            # Any threshold up to this one keeps RECALL; halfway down to the harmless findings leaves most room.
            most = float(kept[int((1 - RECALL) * len(kept))])
            self.threshold = (most + min(most, float(others.max(initial=0.0)))) / 2
        return self

    def probability(self, windows: np.ndarray) -> np.ndarray:
        z = np.concatenate([self._forward(self._patches(windows[k : k + 256]))[2] for k in range(0, len(windows), 256)])
        return 1 / (1 + np.exp(-(self.scale * z.astype(float) + self.offset)))


@functools.cache
def trained() -> CharCnn:
    return CharCnn().fit(labelled_findings())


def scan_texts(texts, model: CharCnn) -> list[list[tuple[int, int, int, float]]]:
    """Per text ``(start, kind, end, probability)`` sorted by start, then kind. Pattern findings keep their place
    whatever the network says of them; runs that none of them covers whole are findings from the threshold on. A pattern
    finding has the greatest probability of itself and of the runs that it touches."""
    both = [(base_spans(t), list(candidates(t))) if t else ([], []) for t in texts]
    asked = list(dict.fromkeys((n, s, e) for n, (own, runs) in enumerate(both) for s, e in [*runs, *((a, b) for a, _, b in own)]))
    seen, best = ((k, x) for k, (n, s, e) in enumerate(asked) for x in views(texts[n], s, e)), np.zeros(len(asked))
    while part := list(islice(seen, 1024)):
        np.maximum.at(best, [k for k, _ in part], model.probability(np.stack([x for _, x in part])))
    found = dict(zip(asked, map(float, best)))
    out = []
    for n, (own, runs) in enumerate(both):
        said, covered = [], set()
        for kind in range(3):
            # Findings of a kind are in order and apart, as runs are: one walk along both.
            at = 0
            for s, e in ((a, b) for a, k, b in own if k == kind):
                p = found[n, s, e]
                while at < len(runs) and runs[at][1] <= s:
                    at += 1
                k = at
                while k < len(runs) and runs[k][0] < e:
                    p = max(p, found[n, *runs[k]])
                    if s <= runs[k][0] and runs[k][1] <= e:
                        covered.add(runs[k])
                    k += 1
                at = max(at, k - 1)
                said.append((s, kind, e, p))
        said += [(*r[:1], 3, r[1], found[n, *r]) for r in runs if r not in covered and found[n, *r] >= model.threshold]
        out.append(sorted(said))
    return out


def _said(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


def scan(docs: DataFrame, model: CharCnn | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model, scores``: counts of pattern findings, digest
    of their list, the list of all findings (code points, end exclusive), how many of them the network added, and the
    probability of each, comma-joined. Findings that start together go by kind. Null and empty texts have none, long ones
    are read whole, repeated rows are each returned, other columns of docs are not looked at, no rows give none."""
    model = model or trained()

    def work(batches):
        for b in batches:
            out = []
            for at in range(0, len(b), 256):
                for spans in scan_texts(b.column(1).slice(at, 256).to_pylist(), model):
                    base = [x for x in spans if x[1] < 3]
                    n = [sum(x[1] == k for x in spans) for k in range(4)]
                    scores = ",".join(f"{x[3]:.4f}" for x in spans)
                    out.append((*n[:3], hashlib.sha256(_said(base).encode()).hexdigest(), _said(spans), n[3], scores))
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.string()]
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model", "scores"])

    small_batches(docs.sparkSession)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long, scores string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, schema)


def redact(docs: DataFrame, model: CharCnn | None = None, text_col: str = "text") -> DataFrame:
    """The same rows with each finding replaced by ``<kind>``, those that overlap together by that of the first to start (ties:
    the kind listed first); clean texts stay as they are, null stays null, empty stays empty, repeated rows and all other
    columns stay, whatever their names. ``n_chars``, where there is one, follows the text. No rows give none."""
    model = model or trained()
    where = docs.columns.index(text_col)

    def work(batches):
        for b in batches:
            texts, done = b.column(where).to_pylist(), []
            for at in range(0, len(texts), 256):
                for text, spans in zip(texts[at : at + 256], scan_texts(texts[at : at + 256], model)):
                    parts, upto = [], 0
                    for s, k, e, _ in spans:
                        if s >= upto:
                            parts += [text[upto:s], f"<{KINDS[k]}>"]
                        upto = max(upto, e)
                    done.append("".join([*parts, text[upto:]]) if spans else text)
            columns = [*b.columns[:where], pa.array(done, b.schema.field(where).type), *b.columns[where + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, names)

    small_batches(docs.sparkSession)
    names = docs.columns
    # Spark looks the columns up by name on the way to Python, which a dot in one would break.
    out = docs.toDF(*[f"_{k}" for k in range(len(names))]).mapInArrow(work, docs.schema)
    return out.withColumn("n_chars", F.when(F.col(text_col).isNull(), F.col("n_chars")).otherwise(F.length(text_col).cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else out
