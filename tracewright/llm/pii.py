"""Personal data by fixed patterns and a character model.

The model is a bidirectional LSTM over character classes with a CRF on top,
written and trained in numpy on labelled spans: invented ones, set in invented
text and in the prose of license texts by a seeded generator.  Its weights are
kept beside this module; `python -m tracewright.llm.pii` trains them anew.

A text is cut into overlapping windows.  Each is decoded by itself into the
probabilities of its characters' tags, forward and backward.  Where windows
overlap, their probabilities are averaged, those from a window's middle weighing
more, and one Viterbi pass over all adjoining windows, however many, finds the
best tags, so that every span is decided once and by all that saw it.  Windows
without a digit or @ near can't hold a span and are not decoded.  Spans of the
model are added where they overlap no span of the patterns and pass the same
tests (Luhn, parts of an address, digits of a phone number, an @).

Defined cases: a null or empty text has no spans; a very long text is decoded
in blocks of windows; repeated documents and rows without doc_id are judged
each by itself; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops

KINDS = ("email", "ip", "card", "phone")

# The base patterns, written so that each is linear in the text.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

WINDOW, MARGIN = 96, 24
STRIDE = WINDOW - 2 * MARGIN
HIDDEN = 16
TAGS = 1 + 2 * len(KINDS)  # outside; first and further characters of each kind

_CLASSES = ["\n", " ", ".", "@", "+", "-", "(", ")", ":", "/", "_", "%", ",", "=", "#", "\"'", "0", "123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ"]
N_CLASSES = len(_CLASSES) + 3  # and other ASCII, other characters, nothing
NOTHING = N_CLASSES - 1
_CLASS_OF = np.full(128, len(_CLASSES), np.int64)
for _k, _chars in enumerate(_CLASSES):
    for _c in _chars:
        _CLASS_OF[ord(_c)] = _k

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: int, text: str) -> bool:
    """Whether what was found may stay: the tests of the base patterns."""
    digits = _digits(text)
    if kind == 1:
        parts = text.split(".")
        return all(p.strip("0") == "" or len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 9 <= len(digits) <= 15
    return "@" in text


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind, then start."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return out


# The model


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def init(rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {}
    for side in "fb":
        w[side + "x"] = rng.normal(0, 0.3, (N_CLASSES, 4 * HIDDEN))
        w[side + "h"] = rng.normal(0, 0.5 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        w[side + "0"] = np.zeros(4 * HIDDEN)
        w[side + "0"][HIDDEN : 2 * HIDDEN] = 1  # remember
    w["out"] = rng.normal(0, 0.2, (2 * HIDDEN, TAGS))
    w["bias"] = np.zeros(TAGS)
    w["move"] = np.zeros((TAGS, TAGS))
    w["start"], w["end"] = np.zeros(TAGS), np.zeros(TAGS)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _lstm(w: dict, side: str, x: np.ndarray, keep: list | None) -> np.ndarray:
    """Hidden states (time, batch, HIDDEN) for classes x (batch, time)."""
    n, time = x.shape
    h = c = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((time, n, HIDDEN), np.float32)
    given = w[side + "x"] + w[side + "0"]
    for t in range(time) if side == "f" else range(time - 1, -1, -1):
        z = given[x[:, t]] + h @ w[side + "h"]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        new = f * c + i * g
        s = np.tanh(new)
        if keep is not None:
            keep.append((t, i, f, o, g, c, h, s))
        c, h = new, o * s
        out[t] = h
    return out


def emissions(w: dict, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Scores (time, batch, tag)."""
    sides = []
    for side in "fb":
        steps: list | None = None
        if keep is not None:
            steps = keep[side] = []
        sides.append(_lstm(w, side, x, steps))
    both = np.concatenate(sides, 2)
    if keep is not None:
        keep["both"] = both
    e = both @ w["out"] + w["bias"]
    e[0] += w["start"]
    e[-1] += w["end"]
    return e


def _back(w: dict, side: str, x: np.ndarray, steps: list, dh_all: np.ndarray, grad: dict) -> None:
    dz_x, dz_h = np.zeros_like(w[side + "x"]), np.zeros_like(w[side + "h"])
    dh = dc = np.zeros((x.shape[0], HIDDEN), np.float32)
    one = np.eye(N_CLASSES, dtype=np.float32)
    for t, i, f, o, g, c, h, s in reversed(steps):
        dh = dh + dh_all[t]
        dc = dc + dh * o * (1 - s * s)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)], 1)
        dz_x += one[x[:, t]].T @ dz
        dz_h += h.T @ dz
        dh, dc = dz @ w[side + "h"].T, dc * f
    grad[side + "x"], grad[side + "h"], grad[side + "0"] = dz_x, dz_h, dz_x.sum(0)


def loss(w: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood of tags y (batch, time) under the CRF, and its gradient, by scaled forward and backward sums."""
    keep: dict = {}
    e = emissions(w, x, keep)
    time, n, _ = e.shape
    top = e.max(2, keepdims=True)
    p, move = np.exp(e - top), np.exp(w["move"])
    a, b, scale = np.empty_like(p), np.empty_like(p), np.empty((time, n, 1), p.dtype)
    for t in range(time):
        a[t] = p[t] if t == 0 else a[t - 1] @ move * p[t]
        scale[t] = a[t].sum(1, keepdims=True)
        a[t] /= scale[t]
    b[-1] = 1
    d_move = np.zeros_like(move)
    for t in range(time - 1, 0, -1):
        onward = b[t] * p[t] / scale[t]
        b[t - 1] = onward @ move.T
        d_move += a[t - 1].T @ onward
    d_move *= move
    marginal = a * b
    gold = y.T
    right = np.take_along_axis(e, gold[:, :, None], 2).sum() + w["move"][gold[:-1], gold[1:]].sum()
    np.put_along_axis(marginal, gold[:, :, None], np.take_along_axis(marginal, gold[:, :, None], 2) - 1, 2)
    np.subtract.at(d_move, (gold[:-1].ravel(), gold[1:].ravel()), 1)
    marginal /= n
    grad = {"move": d_move / n, "bias": marginal.sum((0, 1)), "start": marginal[0].sum(0), "end": marginal[-1].sum(0), "out": keep["both"].reshape(time * n, -1).T @ marginal.reshape(time * n, -1)}
    d_both = marginal @ w["out"].T
    _back(w, "f", x, keep["f"], d_both[:, :, :HIDDEN], grad)
    _back(w, "b", x, keep["b"], d_both[:, :, HIDDEN:], grad)
    return float((np.log(scale).sum() + top.sum() - right) / n), grad


def allowed() -> np.ndarray:
    """Scores of moves: a span's further characters follow only its first or further ones."""
    move = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        for before in range(TAGS):
            if before not in (2 * k + 1, 2 * k + 2):
                move[before, 2 * k + 2] = -1e4
    return move


def probabilities(w: dict, x: np.ndarray) -> np.ndarray:
    """The probability of each tag of each character (time, batch, tag) under the CRF."""
    e = emissions(w, x)
    p, move = np.exp(e - e.max(2, keepdims=True)), np.exp(w["move"] + allowed())
    a, b = np.empty_like(p), np.empty_like(p)
    a[0] = p[0] / p[0].sum(1, keepdims=True)
    for t in range(1, len(p)):
        a[t] = a[t - 1] @ move * p[t]
        a[t] /= a[t].sum(1, keepdims=True)
    b[-1] = 1
    for t in range(len(p) - 1, 0, -1):
        b[t - 1] = (b[t] * p[t]) @ move.T
        b[t - 1] /= b[t - 1].max(1, keepdims=True)
    out = a * b
    return out / out.sum(2, keepdims=True)


def best_tags(score: np.ndarray) -> np.ndarray:
    """The tags (batch, time) of the greatest sum of scores (time, batch, tag) among those that moves allow."""
    time, n, _ = score.shape
    move = allowed()
    total, came = score[0].copy(), np.empty((time, n, TAGS), np.int8)
    for t in range(1, time):
        s = total[:, :, None] + move
        came[t] = s.argmax(1)
        total = np.take_along_axis(s, came[t][:, None, :].astype(np.int64), 1)[:, 0] + score[t]
    tags = np.empty((n, time), np.int8)
    tags[:, -1] = total.argmax(1)
    for t in range(time - 1, 0, -1):
        tags[:, t - 1] = came[t][np.arange(n), tags[:, t]]
    return tags


# Labelled spans


class Generator:
    """Invented text with labelled spans and with numbers that are nobody's."""

    def __init__(self, seed: int, prose: str = ""):
        self.rng = random.Random(seed)
        self.pick = self.rng.choice
        self.prose = prose.split()

    def number(self, n: int) -> str:
        return "".join(self.rng.choices("0123456789", k=n))

    def word(self) -> str:
        letters = self.pick(["etaoinshrdlu", "etaoinshrdlucmfwypvbgk", "aeéèêçoiunrtls", "enirsäöüßtchg", "oñaeríóslc"])
        w = "".join(self.rng.choices(letters, k=self.rng.randrange(1, 13)))
        return self.pick([w, w, w, w, w.title(), w.upper()])

    def email(self) -> str:
        name = self.pick([f"{self.word()}.{self.number(2)}", f"{self.word()}_{self.word()}", self.word() + self.number(self.rng.randrange(4)), f"{self.word()}.{self.word()}"])
        name = re.sub(r"[^a-z0-9._]", "a", name.lower())
        host = f"{self.pick(['mail', 'mx', 'post', ''])}{self.pick(['', self.number(1)])}".strip() or "a"
        at = self.pick(["@", "@", "@", "@", " @ "])
        return f"{name}{at}{host}.{self.pick(['example', 'corp', 'uni', 'web'])}.{self.pick(['com', 'org', 'net', 'de', 'fr'])}"

    def ip(self) -> str:
        return ".".join(str(self.rng.randrange(256)) for _ in range(4))

    def card(self) -> str:
        body = self.pick("3456") + self.number(14)
        digit = next(d for d in "0123456789" if luhn(body + d))
        groups = [(body + digit)[i : i + 4] for i in range(0, 16, 4)]
        return self.pick(["", "", " ", "-", "."]).join(groups)

    def phone(self) -> str:
        a, b, c = self.number(3), self.number(3), self.number(4)
        return self.pick([f"+{self.pick(['1', '1', '44', '49'])} ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"+49 {a} {b}{c}", f"+1-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+33.{a}.{b}.{c}"])

    def other(self) -> str:
        r = self.rng.randrange
        return self.pick([
            lambda: f"{r(1900, 2100)}-{r(1, 13):02}-{r(1, 29):02}", lambda: f"{r(0, 24)}:{r(0, 60):02}:{r(0, 60):02}", lambda: f"{r(0, 1000)},{r(0, 1000):03}.{r(0, 100):02}",
            lambda: f"{r(0, 20)}.{r(0, 20)}.{r(0, 99)}", lambda: f"#{r(1, 10**6)}", lambda: str(r(0, 10 ** int(r(1, 9)))), lambda: f"{r(0, 10)}.{self.number(5)}",
            lambda: f'{self.pick(["token", "secret", "key", "id"])} = "{"".join(self.rng.choices("0123456789abcdef", k=r(24, 42)))}"', lambda: f"@{self.word()}",
            lambda: f"{r(1, 32)}/{r(1, 13)}/{r(1900, 2100)}", lambda: f"CC BY-NC {r(1, 5)}.0.", lambda: f"version {r(1, 9)}.", lambda: "### " + self.word() + "*** |",
        ])()

    def window(self, length: int) -> tuple[str, list[int]]:
        text, tags = "", []
        at = self.rng.randrange(len(self.prose)) if self.prose and self.rng.random() < 0.5 else None
        while len(text) < 3 * length:
            roll = self.rng.random()
            if roll < 0.16:
                kind = self.rng.randrange(len(KINDS))
                piece = getattr(self, KINDS[kind])()
                own = [2 * kind + 1] + [2 * kind + 2] * (len(piece) - 1)
            else:
                piece = self.other() if roll < 0.3 else self.word() if at is None else self.prose[at % len(self.prose)]
                at = at if at is None else at + 1
                own = [0] * len(piece)
            after = self.pick([" ", " ", " ", " ", ", ", ". ", "\n", "### ", '" ', "!! ", " | "])
            text, tags = text + piece + after, tags + own + [0] * len(after)
        a = self.rng.randrange(len(text) - length)
        return text[a : a + length], tags[a : a + length]


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CLASS_OF[np.minimum(points, 127)], NOTHING - 1)


#: Windows and steps of the training; the labelled rows are bounded by their product.
TRAIN_WINDOW, TRAIN_BATCH, TRAIN_STEPS = 56, 48, 1500
WEIGHTS = Path(__file__).parent / "pii_weights.npz"


def prose() -> str:
    return "\n".join(p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))


def fit(seed: int = 7, steps: int = TRAIN_STEPS) -> dict[str, np.ndarray]:
    """The model's weights, by Adam on labelled windows."""
    made = Generator(seed, prose())
    w = init(np.random.default_rng(seed))
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        texts, tags = zip(*(made.window(TRAIN_WINDOW) for _ in range(TRAIN_BATCH)))
        y = np.array(tags)
        for k in range(len(KINDS)):  # a span that begins before the window
            y[:, 0] = np.where(y[:, 0] == 2 * k + 2, 2 * k + 1, y[:, 0])
        _, grad = loss(w, np.array([classes(t) for t in texts]), y)
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 5 / (size + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


@functools.lru_cache(maxsize=1)
def trained() -> dict[str, np.ndarray]:
    """The weights that fit() gave."""
    with np.load(WEIGHTS) as kept:
        return dict(kept)


#: Windows decoded at once, and characters of adjoining windows.
DECODE, DECODE_CHARACTERS = 2048, 1 << 19

#: How much a window says about its characters: most in its middle.
_SAYS = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)


def _regions(known: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(text, first window, last window) of adjoining windows with something to decode; window k sees WINDOW characters from k * STRIDE - MARGIN."""
    anchor = np.zeros(N_CLASSES, bool)
    anchor[[_CLASS_OF[ord(c)] for c in "@01"]] = True
    out = []
    for i, x in enumerate(known):
        at = np.flatnonzero(anchor[x])
        if len(at):
            near = np.unique(np.concatenate([np.maximum(at - MARGIN, 0) // STRIDE, at // STRIDE, np.minimum(at + MARGIN, len(x) - 1) // STRIDE]))
            cut = np.flatnonzero(np.diff(near) > 1) + 1
            out += [(i, int(part[0]), int(part[-1])) for part in np.split(near, cut)]
    return out


def _seen(w: dict, known: list[np.ndarray], regions: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """The averaged probabilities of each region's characters (character, tag), from its first window's first place to its last window's end."""
    todo = [(r, k) for r, (_, a, b) in enumerate(regions) for k in range(a, b + 1)]
    total = [np.zeros(((b - a) * STRIDE + WINDOW, TAGS), np.float32) for _, a, b in regions]
    weight = [np.zeros(((b - a) * STRIDE + WINDOW, 1), np.float32) for _, a, b in regions]
    for at in range(0, len(todo), DECODE):
        part = todo[at : at + DECODE]
        x = np.full((len(part), WINDOW), NOTHING)
        for j, (r, k) in enumerate(part):
            low = k * STRIDE - MARGIN
            own = known[regions[r][0]][max(low, 0) : low + WINDOW]
            x[j, max(-low, 0) : max(-low, 0) + len(own)] = own
        p = probabilities(w, x)
        for j, (r, k) in enumerate(part):
            low = (k - regions[r][1]) * STRIDE
            total[r][low : low + WINDOW] += _SAYS[:, None] * p[:, j]
            weight[r][low : low + WINDOW] += _SAYS[:, None]
    return [t / n for t, n in zip(total, weight)]


def model_tags(w: dict, texts: list[str]) -> list[np.ndarray]:
    """The model's tags for every character of each text."""
    out = [np.zeros(len(t), np.int8) for t in texts]
    known = [classes(t) for t in texts]
    regions = sorted(_regions(known), key=lambda r: r[2] - r[1])
    while regions:
        # regions of like length, together of bounded size
        n, longest = 0, 0
        while n < len(regions):
            longest = (regions[n][2] - regions[n][1]) * STRIDE + WINDOW
            if n and (n + 1) * longest > DECODE_CHARACTERS:
                break
            n += 1
        part, regions = regions[:n], regions[n:]
        seen = _seen(w, known, part)
        score = np.full((max(map(len, seen)), len(part), TAGS), -20, np.float32)
        score[:, :, 0] = 0
        for j, p in enumerate(seen):
            score[: len(p), j] = np.log(p + 1e-9)
        for (i, a, _), tags, p in zip(part, best_tags(score), seen):
            low = a * STRIDE - MARGIN
            own = tags[max(-low, 0) : min(len(p), len(out[i]) - low)]
            out[i][max(low, 0) : max(low, 0) + len(own)] = own
    return out


def tag_spans(tags: np.ndarray) -> list[Span]:
    """Runs of one kind's tags; a first character's tag begins another span."""
    kind = (tags.astype(np.int64) + 1) // 2
    begin = np.ones(len(tags), bool)
    begin[1:] = (kind[1:] != kind[:-1]) | (tags[1:] % 2 == 1)
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(tags))
    return [(int(kind[s]) - 1, int(s), int(e)) for s, e in zip(starts, ends) if kind[s]]


def all_spans(w: dict, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and the model's further ones for each text."""
    out = []
    for text, tags in zip(texts, model_tags(w, texts)):
        base = base_spans(text)
        taken = np.zeros(len(text) + 1, bool)
        for _, s, e in base:
            taken[s:e] = True
        found = []
        for kind, s, e in tag_spans(tags):
            while s < e and text[s].isspace():
                s += 1
            while s < e and text[e - 1] in " \n,.:;-(":
                e -= 1
            if e - s >= 7 and not taken[s:e].any() and valid(kind, text[s:e]):
                found.append((kind, s, e))
        out.append((base, found))
    return out


def _text_of(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_model long"

_HAS = textops._byte_class((0x30, 0x39), (0x40, 0x40))


def find(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans for every document, in RESULT's columns; n_spans counts all spans, n_model those that the model added."""
    weights = trained()
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            for part in textops.chunks(batch.column("text")):
                has = np.add.reduceat(np.append(_HAS[part.data], False), part.offsets[:-1]).astype(bool) & (np.diff(part.offsets) > 0) if len(part.data) else np.zeros(len(part), bool)
                at = np.flatnonzero(has).tolist()
                found = all_spans(weights, [part.bytes_of(i).decode() for i in at])
                counts = np.zeros((len(part), len(KINDS) + 2), np.int64)
                digest, spans = [nothing] * len(part), [""] * len(part)
                for i, (base, more) in zip(at, found):
                    for kind, _, _ in base:
                        counts[i, kind] += 1
                    counts[i, -2:] = len(base) + len(more), len(more)
                    digest[i] = hashlib.sha256(_text_of(base).encode()).hexdigest()
                    spans[i] = _text_of(base + more)
                ids = batch.column("doc_id").slice(part.first, len(part))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(digest), pa.array(spans), pa.array(counts[:, -2]), pa.array(counts[:, -1])], [x.split()[0] for x in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **fit())
