"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans to theirs.

The tagger is trained here, in numpy, from labelled spans in a bounded sample of texts: those of the patterns, and spans written
into windows of clean text in the ways that people write such data and patterns do not match (`forms`: at and dot in words, spaced
or bracketed dots, card and phone digits grouped by other signs), beside digits that are no personal data (`DECOYS`). Where a
pattern matched and its check failed (a card number with a wrong last digit), a window says neither yes nor no and is left out.
Every character of every text lies in windows, which overlap; each position takes the tag of the window in which it lies farthest
from the ends, and spans are read off the whole text. A decoded span is added if the model is sure of it, if it holds what its kind
must hold (`NEEDS`: digits, which for a card pass its check, or @ or the word at, and a dot), and if it touches no span of the patterns. So decoding begins in the windows that
hold such characters, and goes on wherever a tagged run reaches into the next one: the spans are those of decoding every window."""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # none; first and further characters of each kind
WINDOW, STRIDE = 80, 56
MARGIN = (WINDOW - STRIDE) // 2
#: Texts with and without a digit or @ that the tagger is trained on at most: those of least hash; and windows taken from them.
FIT_TEXTS, FIT_WINDOWS = 1200, 2400
#: Windows of each kind taken from one text at most.
PER_TEXT = 16
#: Least mean probability of the tags of a span that is added.
SURE = 0.9
#: Digits that a span of each kind must hold; an email must hold @ or the word at.
NEEDS = (0, 4, 12, 7)

_TRIGGER = re.compile("[0-9@]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WINDOWS = pa.schema([("h", pa.int64()), ("start", pa.int32()), ("kind", pa.int32()), ("chars", pa.string()), ("tags", pa.binary())])
_AT = re.compile(r"@|(?<![A-Za-z])at(?![A-Za-z])", re.IGNORECASE)
_DOT = re.compile(r"\.|(?<![A-Za-z])dot(?![A-Za-z])", re.IGNORECASE)
_LONG = re.compile(r"[0-9](?:[\x20().,/-]*[0-9]){6,}")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    odd = [int(c) for c in digits[::-2]]
    even = [2 * int(c) for c in digits[-2::-2]]
    return (sum(odd) + sum(x - 9 if x > 9 else x for x in even)) % 10 == 0


def emails(text: str):
    """Leftmost matches of local@domain: found from each @, since only one text before it can belong to it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all pattern spans, in order; ends are exclusive, in code points."""
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def windows(text: str) -> list[int]:
    """Where windows start, so that the whole text lies in them."""
    return list(range(0, max(1, len(text) - WINDOW + STRIDE), STRIDE))


def owned(start, n):
    """The positions [lo, hi) of a text of n characters that lie deeper in the window from start on than in its neighbours."""
    return np.where(start == 0, 0, start + MARGIN), np.where(start + WINDOW >= n, n, start + STRIDE + MARGIN)


def characters(text: str, start: int) -> np.ndarray:
    """Classes of the characters of a window: printable ASCII by itself, 95 for others, 96 beyond the end."""
    raw = np.frombuffer(text[start : start + WINDOW].encode("utf-32-le"), np.uint32).astype(np.int64) - 32
    raw[(raw < 0) | (raw > 94)] = 95
    return np.concatenate([raw, np.full(WINDOW - len(raw), 96)])


def window_tags(spans: list[tuple[int, int, int]], start: int) -> np.ndarray:
    tags = np.zeros(WINDOW, np.int64)
    for s, kind, e in spans:
        lo, hi = max(s, start), min(e, start + WINDOW)
        if lo < hi:
            tags[lo - start : hi - start] = 2 + 2 * kind
            if s >= start:
                tags[s - start] = 1 + 2 * kind
    return tags


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Character embedding, an LSTM each way, tag scores, and a linear-chain CRF.

    Arrays are time x batch x width. The input side of the gates depends on the character alone, so it is a table by character."""

    def __init__(self, embed: int = 8, hidden: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        make = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.hidden, self.embed = hidden, embed
        follows = np.zeros((TAGS, TAGS))  # a further character of a kind follows the first or a further one of it
        follows[:, 2::2] = -6
        for k in range(len(KINDS)):
            follows[1 + 2 * k : 3 + 2 * k, 2 + 2 * k] = 1
        self.p = {"E": rng.normal(0, 0.5, (97, embed)), "W": make(2 * hidden, TAGS), "b": np.array([2.0] + [0.0] * (TAGS - 1)), "A": follows, "s": np.zeros(TAGS)}
        for way in "fb":
            self.p |= {f"U{way}": make(embed + hidden, 4 * hidden), f"c{way}": np.repeat([0.0, 1.0, 0.0, 0.0], hidden)}

    def _run(self, chars, way):
        """Hidden states of one way, and what its gradient needs. chars: time x batch, in the order read."""
        U, h_ = self.p["U" + way], self.hidden
        z = (self.p["E"] @ U[: self.embed] + self.p["c" + way])[chars]
        R = U[self.embed :]
        h, c = (np.zeros((*chars.shape, h_), z.dtype) for _ in range(2))
        last_h = last_c = np.zeros((chars.shape[1], h_), z.dtype)
        for t in range(len(chars)):
            z[t] += last_h @ R
            z[t, :, : 3 * h_] = _sigmoid(z[t, :, : 3 * h_])
            z[t, :, 3 * h_ :] = np.tanh(z[t, :, 3 * h_ :])
            i, f, o, u = (z[t, :, k * h_ : (k + 1) * h_] for k in range(4))
            c[t] = last_c = f * last_c + i * u
            h[t] = last_h = o * np.tanh(last_c)
        return h, (chars, z, c, h)

    def _back(self, kept, dh_all, way, grad):
        chars, z, c, h = kept
        U, h_ = self.p["U" + way], self.hidden
        R, dz = U[self.embed :], np.empty_like(z)
        dh = dc = np.zeros_like(c[0])
        th = np.tanh(c)
        for t in range(len(chars) - 1, -1, -1):
            i, f, o, u = (z[t, :, k * h_ : (k + 1) * h_] for k in range(4))
            d = dh_all[t] + dh
            dc = dc + d * o * (1 - th[t] * th[t])
            dz[t, :, :h_] = dc * u * i * (1 - i)
            dz[t, :, h_ : 2 * h_] = dc * c[t - 1] * f * (1 - f) if t else 0
            dz[t, :, 2 * h_ : 3 * h_] = d * th[t] * o * (1 - o)
            dz[t, :, 3 * h_ :] = dc * i * (1 - u * u)
            dh, dc = dz[t] @ R.T, dc * f
        by_char = np.zeros((len(self.p["E"]), 4 * h_), z.dtype)
        order = np.argsort(chars, axis=None, kind="stable")
        flat = chars.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        by_char[flat[first]] = np.add.reduceat(dz.reshape(-1, 4 * h_)[order], first)
        grad["U" + way] = np.concatenate([self.p["E"].T @ by_char, np.tensordot(h[:-1], dz[1:], ([0, 1], [0, 1]))])
        grad["c" + way] = by_char.sum(axis=0)
        grad["E"] = grad["E"] + by_char @ U[: self.embed].T

    def emissions(self, chars):
        chars = chars.T
        hf, kf = self._run(chars, "f")
        hb, kb = self._run(chars[::-1], "b")
        h = np.concatenate([hf, hb[::-1]], axis=2)
        return h @ self.p["W"] + self.p["b"], (h, kf, kb)

    def _chain(self, e):
        """Forward and backward weights, each step scaled to sum to 1; the factors of transitions and steps; and log Z."""
        e = e.astype(float)
        top = e.max(axis=2, keepdims=True)
        x, A = np.exp(e - top), np.exp(self.p["A"].astype(float))
        a, b, norm = np.empty_like(x), np.ones_like(x), np.empty(x.shape[:2])
        for t in range(len(x)):
            a[t] = x[t] * (a[t - 1] @ A if t else np.exp(self.p["s"].astype(float)))
            norm[t] = a[t].sum(axis=1)
            a[t] /= norm[t][:, None]
        w = x / norm[:, :, None]
        for t in range(len(x) - 1, 0, -1):
            b[t - 1] = (w[t] * b[t]) @ A.T
        return a, b, w, A, (np.log(norm) + top[:, :, 0]).sum(axis=0)

    def marginals(self, e):
        a, b, *_ = self._chain(e)
        return a * b

    def gradient(self, chars, tags):
        """(mean loss, gradients) of windows; tags: batch x time."""
        e, (h, kf, kb) = self.emissions(chars)
        a, b, w, A, z = self._chain(e)
        T, n, _ = e.shape
        y, rows = tags.T, np.arange(n)
        at = np.arange(T)[:, None], rows, y
        gold = self.p["s"][y[0]] + e[at].sum(axis=0) + self.p["A"][y[:-1], y[1:]].sum(axis=0)
        de = a * b
        de[at] -= 1
        grad = {"E": 0.0, "s": de[0].sum(axis=0), "A": A * np.tensordot(a[:-1], w[1:] * b[1:], ([0, 1], [0, 1]))}
        np.subtract.at(grad["A"], (y[:-1].ravel(), y[1:].ravel()), 1)
        de = de.astype(h.dtype)
        grad["W"], grad["b"] = h.reshape(T * n, -1).T @ de.reshape(T * n, -1), de.sum(axis=(0, 1))
        dh = de @ self.p["W"].T
        self._back(kf, dh[:, :, : self.hidden], "f", grad)
        self._back(kb, dh[::-1, :, self.hidden :], "b", grad)
        return float((z - gold).mean()), {k: g / n for k, g in grad.items()}

    def fit(self, chars, tags, epochs: int = 12, batch: int = 32, rate: float = 0.02):
        m, v, step, rng = {}, {}, 0, np.random.default_rng(3)
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        for epoch in range(epochs):
            order = rng.permutation(len(chars))
            now = rate * (1 - epoch / epochs)
            for lo in range(0, len(order), batch):
                at, step = order[lo : lo + batch], step + 1
                _, grad = self.gradient(chars[at], tags[at])
                for k, g in grad.items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def _fast(self):
        """Single-precision weights for decoding: inputs by character as a table; gates halved, so that one tanh serves them all."""
        if "R" not in self.__dict__:
            half, embed = np.repeat([0.5, 0.5, 0.5, 1.0], self.hidden), self.embed
            self.X = [((self.p["E"] @ self.p["U" + w][:embed] + self.p["c" + w]) * half).astype(np.float32) for w in "fb"]
            self.R = [(self.p["U" + w][embed:] * half).astype(np.float32) for w in "fb"]
        return zip(self.X, self.R, strict=True)

    def scores(self, chars: np.ndarray) -> np.ndarray:
        """Tag scores, time x batch x tags, as `emissions` has them, in single precision."""
        n, T = chars.shape
        h_, both = self.hidden, []
        for way, (X, R) in enumerate(self._fast()):
            x = X[chars.T[:: -1 if way else 1]]
            out = np.empty((T, n, h_), np.float32)
            h, c = np.zeros((n, h_), np.float32), np.zeros((n, h_), np.float32)
            for t in range(T):
                z = x[t]
                z += h @ R
                np.tanh(z, out=z)
                g = z[:, : 3 * h_] * np.float32(0.5)
                g += np.float32(0.5)
                c *= g[:, h_ : 2 * h_]
                c += g[:, :h_] * z[:, 3 * h_ :]
                h = np.tanh(c)
                h *= g[:, 2 * h_ :]
                out[t] = h
            both.append(out[:: -1 if way else 1] @ self.p["W"][way * h_ : (way + 1) * h_].astype(np.float32))
        return both[0] + both[1] + self.p["b"].astype(np.float32)

    def possible(self, e: np.ndarray) -> np.ndarray:
        """Windows whose best path has a tag. First, windows in which every other tag loses more by its score than transitions to it
        and out of it can gain are left out; then the score of the best path is compared with that of none throughout."""
        A = (self.p["A"] - self.p["A"][0, 0]).astype(np.float32)
        gain = e[:, :, 1:].max(axis=2) - e[:, :, 0]
        enter = np.full(len(e), A[:, 1:].max())
        enter[0] = (self.p["s"][1:] - self.p["s"][0]).max()
        some = np.flatnonzero((gain + enter[:, None] + max(0.0, A[1:, 0].max()) > 0).any(axis=0))
        over = (e[:, some] - e[:, some, :1]).astype(np.float32)
        best = over[0] + (self.p["s"] - self.p["s"][0]).astype(np.float32)
        for x in over[1:]:
            step = best[:, :1] + A[0]
            for k in range(1, TAGS):
                np.maximum(step, best[:, k : k + 1] + A[k], out=step)
            best = step + x
        return some[best.max(axis=1) > 0]

    def find(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(windows that may have tags, their tags, the probabilities of these)."""
        e = self.scores(chars)
        some = self.possible(e)
        return some, *self._best(e[:, some].astype(float))

    def decode(self, chars):
        """(tags, their probabilities), batch x time: the best path, and how sure each of its tags is."""
        return self._best(self.emissions(chars)[0])

    def _best(self, e):
        T, n, _ = e.shape
        score, back = e[0] + self.p["s"], []
        for t in range(1, T):
            s = score[:, :, None] + self.p["A"]
            back.append(s.argmax(axis=1))
            score = s.max(axis=1) + e[t]
        path = [score.argmax(axis=1)]
        for k in reversed(back):
            path.append(k[np.arange(n), path[-1]])
        tags = np.array(path[::-1])
        sure = np.take_along_axis(self.marginals(e), tags[:, :, None], axis=2)[:, :, 0]
        return tags.T, sure.T


def reconcile(n: int, starts: list[int], tags: np.ndarray, sure: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, mean probability) of the spans of a text of n characters, from the tags of windows; windows left out have no tags."""
    out, open_ = [], None
    for s, ts, ps in zip(starts, tags, sure, strict=True):
        lo, hi = (int(x) for x in owned(s, n))
        for at in (lo + np.flatnonzero(ts[lo - s : hi - s])).tolist():
            t, p = int(ts[at - s]), float(ps[at - s])
            kind, first = (t - 1) // 2, t % 2 == 1
            if open_ and (first or kind != open_[1] or at != open_[2]):
                out.append(open_)
                open_ = None
            open_ = (open_[0], kind, at + 1, [*open_[3], p]) if open_ else (at, kind, at + 1, [p])
    return [(s, k, e, float(np.mean(p))) for s, k, e, p in out + ([open_] if open_ else [])]


def _digits(rng, *counts: int) -> list[str]:
    return ["".join(str(x) for x in rng.integers(0, 10, n)) for n in counts]


def _word(rng) -> str:
    return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9)))


def forms(kind: int, rng: np.random.Generator) -> str:
    """Made-up personal data of a kind, as people write it."""
    pick = lambda *x: str(x[int(rng.integers(len(x)))])
    if KINDS[kind] == "email":
        at = pick("@", "@", " @ ", " at ", "(at)", " (at) ", "[at]", " [at] ", " AT ")
        dot = pick(" dot ", "(dot)", " [dot] ", " DOT ", " . ", ".") if at.strip() != "@" else pick(".", " . ")
        local = pick(_word(rng), f"{_word(rng)}.{_word(rng)}", f"{_word(rng)}.{rng.integers(100)}", f"{_word(rng)}{rng.integers(100)}")
        host = [_word(rng) + pick("", "", str(rng.integers(10))) for _ in range(int(rng.integers(1, 3)))] + [pick("com", "org", "net", "de", "fr", "es", "edu")]
        return local + at + dot.join(host)
    if KINDS[kind] == "ip":
        return pick(".", " . ", "[.]", " dot ", "(.)").join(str(x) for x in rng.integers(0, 256, 4))
    if KINDS[kind] == "card":
        groups = _digits(rng, *((4, 4, 4, 4) if rng.integers(4) else (4, 6, 5)))
        groups[-1] = next(last for x in range(10) if luhn("".join(groups[:-1]) + (last := groups[-1][:-1] + str(x))))
        return pick("", " ", "-", ".", "/", "  ", "_", " - ").join(groups)
    area, first, last = _digits(rng, 3, 3, 4)
    code, sep = str(rng.integers(1, 99)), pick("-", " ", ".", "/")
    return pick(f"+{code} ({area}) {first}-{last}", f"({area}) {first}{sep}{last}", f"({area}){first}-{last}", f"{area}{sep}{first}{sep}{last}", f"00{code} {area} {first}{last}", f"0{area}{sep}{first}{last}", f"+{code} / {area} / {first}{last}")


#: Digits and signs in running text that are no personal data: made by rule, like the forms.
DECOYS = (
    lambda r: f"{r.integers(1900, 2100)}-{r.integers(1, 13):02d}-{r.integers(1, 29):02d}", lambda r: f"{r.integers(0, 24):02d}:{r.integers(0, 60):02d}:{r.integers(0, 60):02d}",
    lambda r: f"{r.integers(1, 32)}.{r.integers(1, 13)}.{r.integers(1900, 2100)}", lambda r: f"{r.integers(1, 1000)},{r.integers(0, 1000):03d}.{r.integers(0, 100):02d}", lambda r: str(r.integers(0, 10**6)),
    lambda r: f"v{r.integers(0, 20)}.{r.integers(0, 20)}.{r.integers(0, 20)}", lambda r: "".join(r.choice(list("0123456789abcdef"), int(r.integers(12, 41)))), lambda r: f"{r.integers(1900, 2100)}-{r.integers(1900, 2100)}",
    lambda r: f"{_word(r)} at {_word(r)}", lambda r: f"@{_word(r)}", lambda r: f"at {r.integers(1, 100)} dot {_word(r)}", lambda r: f"{_word(r)}.{_word(r)}.com", lambda r: f"{r.integers(1, 100)} / {r.integers(1, 100)}", lambda r: f"#{r.integers(0, 10**7)}",
)


def written(chars: str, rng: np.random.Generator) -> tuple[str, np.ndarray]:
    """A clean window with made-up personal data, or a decoy, written over a place between two words; and its tags."""
    kind = int(rng.integers(len(KINDS) + 2))
    new = forms(kind, rng) if kind < len(KINDS) else DECOYS[int(rng.integers(len(DECOYS)))](rng)
    gaps = [m.start() for m in re.finditer(" ", chars)] or [len(chars)]
    at = gaps[int(rng.integers(len(gaps)))]
    before, after = chars[:at], chars[at + 1 :]
    text = f"{before} {new} {after}" if rng.integers(4) else f"{before} {new}{'.,;!#$%&*)'[int(rng.integers(10))]} {after}"
    start = len(before) + 1
    shift = max(0, int(rng.integers(start + 1)) - 8) if start + len(new) > WINDOW else 0
    spans = [(start - shift, kind, start - shift + len(new))] if kind < len(KINDS) else []
    return text[shift : shift + WINDOW], window_tags(spans, 0) if not spans or spans[0][0] >= 0 else window_tags([(0, *spans[0][1:])], 0)


def _labelled(per_text: int):
    """At most per_text windows of each kind from every text, with the tags of its pattern spans; none with digits that a pattern took and its check refused."""

    def run(batches):
        for batch in batches:
            out = []
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True):
                spans, lo, room = patterns(text), 0, [per_text] * (len(KINDS) + 1)
                for s in windows(text):
                    while lo < len(spans) and spans[lo][2] <= s:
                        lo += 1
                    inside = spans[lo : bisect.bisect_left(spans, (s + WINDOW,))]
                    tags = window_tags(inside, s)
                    kind = int((tags.max() + 1) // 2)
                    open_ = any(tags[m.start() - s : m.end() - s].min() == 0 for m in _LONG.finditer(text, s, s + WINDOW))
                    if room[kind] and not open_:
                        room[kind] -= 1
                        out.append((h, s, kind, text[s : s + WINDOW], tags.astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip(("h", "start", "kind", "chars", "tags"), x, strict=True)) for x in out], _WINDOWS)

    return run


def train(docs: DataFrame, fit_texts: int = FIT_TEXTS, fit_windows: int = FIT_WINDOWS, per_text: int = PER_TEXT) -> Tagger | None:
    """A tagger from labelled windows of a bounded sample of docs(text), or None where there are no texts.

    The sample: of the distinct texts with a digit or @, and of those without, the fit_texts of least hash. Tasks take about twice
    as many, by thresholds of the hash, and cut windows from them; the driver gets these windows only, however many or long the
    texts are. Half of the windows hold spans of the patterns, each kind with equal room, and clean text; the other half are clean
    ones into which `written` puts personal data in other forms, or decoys."""
    hot = F.col("text").rlike("[0-9@]")
    hashed = docs.select("text").filter("text is not null").withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 1)).withColumn("hot", hot)
    distinct = {r["hot"]: r["n"] for r in hashed.groupBy("hot").agg(F.approx_count_distinct("h").alias("n")).collect()}
    below = {x: min((1 << 63) - 1, int(2 * fit_texts / max(distinct.get(x, 0), 1) * (1 << 63))) for x in (True, False)}
    texts = hashed.filter(F.when(F.col("hot"), F.lit(below[True])).otherwise(F.lit(below[False])) >= F.col("h")).groupBy("h").agg(F.max("text").alias("text"), F.max("hot").alias("hot"))
    found = texts.select("h", "text").mapInArrow(_labelled(per_text), "h long, start int, kind int, chars string, tags binary").collect()
    found = sorted(found, key=lambda w: (w.h, w.start))
    room = fit_windows // 2 // (len(KINDS) + 1)
    kept = [w for kind in range(len(KINDS) + 1) for w in [w for w in found if w.kind == kind][:room]]
    clean = [w.chars for w in found if w.kind == 0]
    if not clean and not kept:
        return None
    rng = np.random.default_rng(11)
    made = [written(clean[int(rng.integers(len(clean)))] if clean else "", rng) for _ in range(fit_windows // 2)]
    chars = [characters(w.chars, 0) for w in kept] + [characters(c, 0) for c, _ in made]
    tags = [np.frombuffer(w.tags, np.uint8) for w in kept] + [t for _, t in made]
    return Tagger().fit(np.array(chars), np.array(tags, np.int64))


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


class _Windows:
    """All windows of a block of texts: the text and the start of each, and the classes of its characters."""

    def __init__(self, texts: list[str]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32) - 32
        self.raw = np.append(np.where((raw < 0) | (raw > 94), 95, raw), 96).astype(np.uint8)
        count = np.maximum(-(-(self.sizes - WINDOW + STRIDE) // STRIDE), 1) * (self.sizes > 0)
        self.of = np.repeat(np.arange(len(texts)), count)
        self.start = (np.arange(len(self.of)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
        self.begin = np.cumsum(self.sizes + 1) - self.sizes - 1

    def chars(self, some: np.ndarray) -> np.ndarray:
        at = self.start[some][:, None] + np.arange(WINDOW)
        return self.raw[np.where(at < self.sizes[self.of[some]][:, None], at + self.begin[self.of[some]][:, None], len(self.raw) - 1)]

    def hot(self) -> np.ndarray:
        """Windows with a digit, an @ or the word at. A span that lies in others alone has nothing that its kind must hold."""
        r = self.raw
        small = np.where((r >= 33) & (r <= 58), r + 32, r)
        letter = (small >= 65) & (small <= 90)
        word = np.flatnonzero((small[:-1] == 65) & (small[1:] == 84))
        word = word[~letter[np.maximum(word - 1, 0)] | (word == 0)]
        word = word[~letter[np.minimum(word + 2, len(r) - 1)]]
        mark = (r >= 16) & (r <= 25) | (r == 32)
        mark[word] = mark[word + 1] = True
        upto = np.concatenate([[0], np.cumsum(mark)])
        lo = self.begin[self.of] + self.start
        hi = self.begin[self.of] + np.minimum(self.start + WINDOW, self.sizes[self.of])
        return np.flatnonzero(upto[hi] > upto[lo])

    def beside(self, some: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """Windows into which a tagged run reaches from these."""
        lo, hi = owned(self.start[some], self.sizes[self.of[some]])
        row = np.arange(len(some))
        left = (lo > 0) & (tags[row, lo - self.start[some]] > 0)
        right = (hi < self.sizes[self.of[some]]) & (tags[row, hi - 1 - self.start[some]] > 0)
        return np.concatenate([some[left] - 1, some[right] + 1])


def _decoded(tagger: Tagger, w: _Windows) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(tags, probabilities) by window. Begins where a span may be and follows tagged runs into the windows beside, so that the spans are those of decoding every window."""
    done, out, todo = set(), {}, w.hot()
    while len(todo):
        done.update(todo.tolist())
        reached = []
        for k in range(0, len(todo), 512):
            some, tags, probs = tagger.find(w.chars(todo[k : k + 512]))
            some = todo[k + some]
            out.update(zip(some.tolist(), zip(tags, probs, strict=True), strict=True))
            reached.append(w.beside(some, tags))
        todo = np.array(sorted(set(np.concatenate(reached).tolist()) - done), np.int64)
    return out


def _holds(span: str, kind: int) -> bool:
    """Whether a span has what its kind must have. The digits of a card pass the check by which the pattern's are judged."""
    if kind == 0:
        return _AT.search(span) is not None and _DOT.search(span) is not None
    digits = re.sub("[^0-9]", "", span)
    return len(digits) >= NEEDS[kind] and (KINDS[kind] != "card" or (len(digits) <= 19 and luhn(digits)))


def _added(tagger: Tagger | None, texts: list[str], base: list[list], sure: float) -> list[list]:
    out = [[] for _ in texts]
    if tagger is None or not texts:
        return out
    w = _Windows(texts)
    found = _decoded(tagger, w)
    of_text: dict[int, list[int]] = {}
    for x in sorted(found):
        of_text.setdefault(int(w.of[x]), []).append(x)
    for k, xs in of_text.items():
        text, covered = texts[k], bytearray(len(texts[k]))
        for s, _, e in base[k]:
            covered[s:e] = b"\1" * (e - s)
        for s, kind, e, p in reconcile(len(text), w.start[xs].tolist(), [found[x][0] for x in xs], [found[x][1] for x in xs]):
            if p >= sure and _holds(text[s:e], kind) and 1 not in covered[s:e]:
                out[k].append((s, kind, e))
    return out


def _find(tagger: Tagger | None, sure: float):
    def run(batches):
        for batch in batches:
            ids, col = batch.column("doc_id"), common.text_column(batch)
            for lo, hi, _, _ in common.byte_blocks(col, 1 << 20):
                texts = col.slice(lo, hi - lo).to_pylist()
                base = [patterns(t) if _TRIGGER.search(t) else [] for t in texts]
                new = _added(tagger, texts, base, sure)
                counts = [[sum(s[1] == kind for s in b) for b in base] for kind in range(len(KINDS))]
                digest = [hashlib.sha256(_joined(b).encode()).hexdigest() for b in base]
                spans = [_joined(sorted(b + a)) for b, a in zip(base, new, strict=True)]
                cols = [ids.slice(lo, hi - lo), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array([len(a) for a in new], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return run


def find(docs: DataFrame, tagger: Tagger | None, sure: float = SURE) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for each row of docs(doc_id, text).

    Counts and base_sha256 are of the pattern spans, spans of these and the added ones, as kind:start:end in code points. Null,
    empty and clean texts have no spans: counts 0, the hash of the empty text, and ''. Texts of any length are decoded whole, in
    windows. Rows that repeat are answered alike, other columns are not read, and an empty table gives no rows."""
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return docs.select("doc_id", "text").mapInArrow(_find(tagger, sure), schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return find(docs, train(docs))
