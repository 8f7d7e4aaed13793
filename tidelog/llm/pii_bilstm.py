"""Personal data: base patterns, and a character-level bidirectional LSTM with a CRF.

The base spans are exact (``base_spans``).  The model reads every whole text in windows of
``WINDOW`` characters that begin every ``STEP``; a character's evidence is the mean over
the windows that hold it, weighted towards their middles.  The CRF then decodes each whole
text at once.  Where a character is so surely outside that no best path can tag it
(``anchored``), the chain falls apart, so stretches between such characters are decoded
beside each other, with the whole chain's result; nothing is cut and no window is left out.

A decoded span is added if it touches no base span, its log-odds against the same path
without it reach ``SURE``, and it passes the test of its kind (``holds``): a card has 13 to
19 digits and its check digit fits, an address parses, a phone number has 10 to 15 digits,
an email address has one @ between a name and a dotted host.

Training is in numpy, from labelled spans: those of the base patterns in at most
``TRAIN_DOCUMENTS`` documents of at most ``TRAIN_CHARS`` characters, and generated ones
(forms that the patterns leave out, and look-alikes that are nothing) set into the same
documents' text; ``TRAIN_WINDOWS`` windows, a third of them around base spans at most.
No other part is bounded; every whole text is read.

Defined results: null text counts as empty; repeated rows get equal rows; null ids stay and
teach nothing; ties of equally good paths go to the tag listed first; a text of any length
is decoded in time in proportion to it; only doc_id and text are read, so other columns,
whatever their names, change nothing; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ids_and_texts, keep_freed, map_batches, read_table, texts_of
from .quality_crf import marginals
from .textvec import slices
from .training import documents_sample

KINDS = ("email", "ip", "card", "phone")
WINDOW, STEP, HIDDEN, EPOCHS, BATCH = 128, 96, 16, 14, 64
TRAIN_DOCUMENTS, TRAIN_CHARS, TRAIN_WINDOWS, TRAIN_LENGTH = 600, 8_000, 3200, 64
#: Windows computed beside each other: what a step works on stays in a core's cache.
_TOGETHER = 1024
#: Nats by which the path with a span must beat the path without it.
SURE = 2.0

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive where nothing could be given back, so that long digit runs stay linear
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _part(digits: str) -> bool:
    """Whether a run of digits, however many zeros lead it, is at most 255."""
    rest = digits.lstrip("0")
    return len(rest) <= 3 and int(rest or "0") <= 255


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    text = text or ""
    out: list[tuple[str, int, int]] = []
    last, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(_part(p) for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


#: Character classes: each digit, ASCII letters by case, marks of their own, other letters, rest.
_MARKS = "@.+-_() %/:;,='\"#&|\n"
_UPPER, _LOWER, _HEX, _FOREIGN, _REST = range(10, 15)
_FIRST_MARK = 15
_CLASSES = _FIRST_MARK + len(_MARKS)
_BLANK, _AT = _FIRST_MARK + _MARKS.index(" "), _FIRST_MARK + _MARKS.index("@")


def _class_table() -> np.ndarray:
    out = np.full(129, _REST, dtype=np.int64)  # 128 stands for all others
    for c in range(128):
        if 48 <= c <= 57:
            out[c] = c - 48
        elif 97 <= c <= 122:
            out[c] = _HEX if c <= 102 else _LOWER
        elif 65 <= c <= 90:
            out[c] = _UPPER
        elif chr(c) in _MARKS:
            out[c] = _FIRST_MARK + _MARKS.index(chr(c))
    out[128] = _FOREIGN
    return out


_TABLE = _class_table()


def classes(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _TABLE[np.minimum(cp, 128)]


def _lstm(x: np.ndarray, p: dict, d: str, keep: bool = False):
    """Hidden states (time, batch, HIDDEN) of one direction over class numbers x (batch, time).
    Gates in the order in, forget, out, candidate; a sigmoid is a tanh of half its argument."""
    n, steps = x.shape
    kind, size = p["wh" + d].dtype, p["wh" + d].shape[0]
    half = np.ones(4 * size, kind)
    half[: 3 * size] = 0.5
    wx, wh = (p["wx" + d] + p["b" + d]) * half, p["wh" + d] * half
    h, c = np.zeros((n, size), kind), np.zeros((n, size), kind)
    out = np.empty((steps, n, size), kind)
    z, t = np.empty((n, 4 * size), kind), np.empty((n, size), kind)
    column = np.ascontiguousarray(x.T)
    cache = []
    for k in range(steps):
        np.dot(h, wh, out=z)
        z += wx[column[k]]
        np.tanh(z, out=z)
        gates, g = z[:, : 3 * size], z[:, 3 * size :]
        gates += 1
        gates *= 0.5
        if keep:
            cache.append((z.copy(), c.copy(), h))
        c *= gates[:, size : 2 * size]
        np.multiply(gates[:, :size], g, out=t)
        c += t
        np.tanh(c, out=t)
        h = out[k]
        np.multiply(t, gates[:, 2 * size :], out=h)
        if keep:
            cache[-1] += (t.copy(),)
    return out, cache


def _lstm_back(x: np.ndarray, p: dict, d: str, cache: list, dout: np.ndarray, grad: dict) -> None:
    """Adds the gradients of one direction, given those of its hidden states (time, batch, HIDDEN)."""
    n, steps = x.shape
    size = p["wh" + d].shape[0]
    dh, dc = np.zeros((n, size), dout.dtype), np.zeros((n, size), dout.dtype)
    every = np.empty((steps, n, 4 * size), dout.dtype)
    for k in range(steps - 1, -1, -1):
        z, before, h_before, tc = cache[k]
        i, f, o, g = z[:, :size], z[:, size : 2 * size], z[:, 2 * size : 3 * size], z[:, 3 * size :]
        dh = dh + dout[k]
        dc = dc + dh * o * (1 - tc * tc)
        dz = every[k]
        dz[:, :size], dz[:, size : 2 * size] = dc * g * i * (1 - i), dc * before * f * (1 - f)
        dz[:, 2 * size : 3 * size], dz[:, 3 * size :] = dh * tc * o * (1 - o), dc * i * (1 - g * g)
        grad["wh" + d] += h_before.T @ dz
        dh, dc = dz @ p["wh" + d].T, dc * f
    flat = every.reshape(-1, 4 * size)
    grad["b" + d] += flat.sum(axis=0)
    hot = (np.arange(len(p["wx" + d]))[:, None] == x.T.ravel()).astype(dout.dtype)
    grad["wx" + d] += hot @ flat


def _states(x: np.ndarray, p: dict, keep: bool = False):
    forward, cf = _lstm(x, p, "f", keep)
    backward, cb = _lstm(x[:, ::-1], p, "b", keep)
    return np.concatenate([forward, backward[::-1]], axis=2), cf, cb


def _quick_tanh() -> bool:
    """Whether numpy's tanh here is as quick as its exp, which it is with AVX-512 only; without,
    it takes several times as long."""
    try:
        return np.lib.introspect.opt_func_info(func_name="^tanh$", signature="float32")["tanh"]["ff"]["current"].startswith("AVX512")
    except (AttributeError, KeyError):
        return False


_BY_TANH = _quick_tanh()


def _scores(x: np.ndarray, p: dict, d: str, out: np.ndarray, add: bool) -> None:
    """Writes to out, or adds to it, what the hidden states of one direction weigh for each tag:
    those that _lstm gives for class numbers (time, batch), without what training needs.  Gates
    lie apart; signs and factors are in the weights.  By tanh, h is twice the hidden state;
    without a quick one all is exponentials, c is -2 times the cell, and what overflows is
    infinite, with its gate or state at the limit."""
    steps, n = x.shape
    kind, size = p["wh" + d].dtype, p["wh" + d].shape[0]
    apart = lambda w: np.ascontiguousarray(w.reshape(len(w), 4, size).transpose(1, 0, 2))
    scale, twice = np.repeat(np.array([0.5, 0.5, 0.5, 1] if _BY_TANH else [-1, -1, -1, 2], kind), size), kind.type(0.5 if _BY_TANH else 1)
    wx, wh = apart((p["wx" + d] + p["b" + d]) * scale), apart(p["wh" + d] * scale * twice)
    wo = (p["wo"][:size] if d == "f" else p["wo"][size:]) * twice
    h, t, e = np.zeros((n, size), kind), np.empty((n, size), kind), np.empty((n, wo.shape[1]), kind)
    z, g, s = np.empty((4, n, size), kind), np.empty((4, n, size), kind), np.zeros((2, n, size), kind)
    sigmoids, o, (u, c) = z[:3], z[2], s
    half, one, two, four = (np.array(v, kind) for v in (0.5, 1, 2, 4))  # arrays, which cost less a call
    with np.errstate(over="ignore"):
        for k in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.matmul(h, wh, z)
            wx.take(x[k], 1, g, "clip")
            np.add(z, g, z)
            if _BY_TANH:
                np.tanh(z, z)
                np.add(sigmoids, one, sigmoids)
                np.multiply(c, z[1], c)
                np.multiply(z[0], z[3], u)
                np.add(c, u, c)
                np.multiply(c, half, c)
                np.tanh(c, t)
                np.multiply(t, o, h)
            else:
                np.exp(z, z)
                np.add(z, one, z)
                np.divide(four, z[3], u)  # 4 / (1 + exp 2a) - 2 is -2 tanh a
                np.subtract(u, two, u)
                np.divide(s, z[:2], s)
                np.add(c, u, c)
                np.exp(c, t)
                np.add(t, one, t)
                np.divide(two, t, t)
                np.subtract(t, one, t)
                np.divide(t, o, h)
            if add:
                np.matmul(h, wo, e)
                np.add(out[k], e, out[k])
            else:
                np.matmul(h, wo, out[k])


def emissions(x: np.ndarray, p: dict) -> np.ndarray:
    """(time, batch, tag) scores of windows of class numbers (time, batch)."""
    out = np.empty((*x.shape, len(p["bo"])), p["wo"].dtype)
    _scores(x, p, "f", out, add=False)
    _scores(x, p, "b", out, add=True)
    flat = out.reshape(len(x), -1)
    flat += np.tile(p["bo"], x.shape[1])
    return out


def loss_and_gradients(x: np.ndarray, y: np.ndarray, p: dict) -> tuple[float, dict]:
    """Mean negative log-likelihood of tags y (batch, time) of windows x, and its gradients."""
    k, (n, steps) = len(p["bo"]), x.shape
    h, cf, cb = _states(x, p, keep=True)
    e = (h @ p["wo"] + p["bo"]).transpose(1, 0, 2).reshape(-1, k).astype(np.float64)
    prob, pairs, z = marginals(e, p["trans"].astype(np.float64), np.arange(n + 1) * steps)
    flat = y.ravel()
    seen = np.zeros((k, k))
    np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    loss = (z - e[np.arange(len(e)), flat].sum() - (seen * p["trans"]).sum()) / n
    prob[np.arange(len(e)), flat] -= 1
    de = (prob.reshape(n, steps, k).transpose(1, 0, 2) / n).astype(h.dtype)
    g = {name: np.zeros_like(v) for name, v in p.items()}
    g["trans"] = ((pairs - seen) / n).astype(h.dtype)
    g["wo"], g["bo"] = np.tensordot(h, de, ((0, 1), (0, 1))), de.sum(axis=(0, 1))
    dh, size = de @ p["wo"].T, p["whf"].shape[0]
    _lstm_back(x, p, "f", cf, dh[:, :, :size], g)
    _lstm_back(x[:, ::-1], p, "b", cb, dh[::-1, :, size:], g)
    return float(loss), g


def first_weights(rng: np.random.Generator, size: int = HIDDEN) -> dict:
    k = len(KINDS) + 1
    p: dict[str, np.ndarray] = {}
    for d in "fb":
        p["wx" + d] = rng.normal(0, 0.3, (_CLASSES, 4 * size))
        p["wh" + d] = rng.normal(0, 0.2, (size, 4 * size))
        p["b" + d] = np.zeros(4 * size)
        p["b" + d][size : 2 * size] = 1.0
    p["wo"], p["bo"], p["trans"] = rng.normal(0, 0.3, (2 * size, k)), np.zeros(k), np.eye(k)
    return p


def fit(windows: np.ndarray, tags: np.ndarray, seed: int = 3) -> dict:
    """BiLSTM and transitions by maximum likelihood with Adam; windows and tags (n, time)."""
    rng = np.random.default_rng(seed)
    p = {n: v.astype(np.float32) for n, v in first_weights(rng).items()}
    m = {n: np.zeros_like(v) for n, v in p.items()}
    s = {n: np.zeros_like(v) for n, v in p.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(windows))
        rate = 0.012 * (1 - 0.95 * epoch / EPOCHS)
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            _, g = loss_and_gradients(windows[some], tags[some], p)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            step += 1
            for n in p:
                v = g[n] * np.float32(min(1.0, 5.0 / (norm + 1e-9)))
                m[n] = np.float32(0.9) * m[n] + np.float32(0.1) * v
                s[n] = np.float32(0.999) * s[n] + np.float32(0.001) * v * v
                p[n] = p[n] - np.float32(rate) * (m[n] / np.float32(1 - 0.9**step)) / (np.sqrt(s[n] / np.float32(1 - 0.999**step)) + np.float32(1e-8))
    return p


def with_check_digit(digits: str) -> str:
    return digits + next(c for c in "0123456789" if luhn(digits + c))


def generated(rng: np.random.Generator) -> tuple[str, str | None]:
    """A made-up string and its kind; None for look-alikes that are no personal data.
    A number that is written as cards are is one here, whatever its check digit: that is
    tested afterwards."""
    pick = lambda *a: a[rng.integers(len(a))]
    num = lambda n: "".join(str(rng.integers(10)) for _ in range(n))
    word = lambda a, b, s="abcdefghijklmnopqrstuvwxyz": "".join(s[rng.integers(len(s))] for _ in range(rng.integers(a, b)))
    hexes = lambda a, b: word(a, b, "0123456789abcdef")
    kind = int(rng.integers(32))
    if kind == 0:
        return f"{word(3, 9)}{pick('.', '_', '')}{num(int(rng.integers(3)))}@{word(3, 8)}{pick('', num(1))}.{pick('', word(3, 9) + '.')}{word(2, 4)}", "email"
    if kind in (1, 2):
        return f"{word(2, 9)}{word(1, 3, 'éèñöüßç')}@{word(3, 10)}.{word(2, 4)}", "email"
    if kind == 3:
        return f"{word(2, 9)}{pick('', '.' + word(2, 6))}@{word(2, 6)}{word(1, 2, 'éèñöüä')}{word(2, 6)}.{word(2, 4)}", "email"
    if kind == 4:
        return ".".join(str(rng.integers(256)) for _ in range(4)), "ip"
    if kind in (5, 6):
        return ":".join(hexes(4, 5) if rng.random() < 0.7 else hexes(1, 4) for _ in range(8)), "ip"
    if kind == 7:
        return f"{pick('fe80', '2001:db8', 'fd00')}::{':'.join(hexes(2, 5) for _ in range(rng.integers(2, 5)))}", "ip"
    if kind in (8, 9):
        digits, sep = with_check_digit(pick("4", "51", "55", "6011") + num(14))[:16], pick(".", ".", "/", "_", "")
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4)) if sep else digits, "card"
    if kind in (10, 11):
        digits, sep = with_check_digit(pick("34", "37") + num(12)), pick("", " ", "-")
        return sep.join((digits[:4], digits[4:10], digits[10:])), "card"
    if kind == 12:
        digits, sep = with_check_digit(pick("30", "36", "38") + num(11)), pick("", " ", "-")
        return sep.join((digits[:4], digits[4:10], digits[10:])), "card"
    if kind in (13, 14):
        return pick(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"({num(3)}){num(3)}-{num(4)}"), "phone"
    if kind == 15:
        return pick(f"00{pick('1', '33', '34', '44', '49')} {num(2)} {num(4)} {num(4)}", f"00{pick('33', '34', '44', '49')} {num(3)} {num(3)} {num(3)}"), "phone"
    if kind == 16:
        return pick(f"+{rng.integers(1, 99)} ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(6)}", f"+{num(2)}/{num(3)}/{num(6)}"), "phone"
    if kind == 17:
        return hexes(16, 41), None
    if kind == 18:
        return pick(f"{pick('19', '20')}{num(2)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/{num(4)}", f"20{num(2)}-{num(2)}-{num(2)}T{num(2)}:{num(2)}:{num(2)}"), None
    if kind == 19:
        return num(int(rng.integers(1, 13))), None
    if kind == 20:
        return pick(f"{num(2)}.{num(3)},{num(2)}", f"${num(1)},{num(3)}.{num(2)}", f"{num(1)}.{num(6)}", f"{num(1)},{num(3)},{num(3)},{num(3)}"), None
    if kind == 21:
        return "AKIA" + word(16, 17, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), None
    if kind == 22:
        return pick(f"v{num(1)}.{num(2)}.{num(1)}", f"{num(1)}.{num(1)}.{num(2)}"), None
    if kind == 23:
        return f"{pick('password', 'token', 'api_key')}={word(12, 24, 'ABCDEFabcdefghijk0123456789')}", None
    if kind == 24:
        return pick("16", "17") + num(int(pick(8, 11, 14, 17))), None  # moments
    if kind == 25:
        return pick("1", "2", "7", "8", "9", "0") + num(int(rng.integers(12, 19))), None  # long numbers
    if kind == 26:
        return f"{word(2, 5, 'ABCDEFGHKLMNPRST')}-{num(4)}-{num(int(rng.integers(4, 9)))}", None
    if kind == 27:
        return ":".join(hexes(2, 3) for _ in range(6)), None
    if kind == 28:
        return f"97{pick('8', '9')}-{num(1)}-{num(2)}-{num(6)}-{num(1)}", None
    if kind == 29:
        return pick(f"{num(2)}:{num(2)}:{num(2)}", f"{num(4)}-{num(4)}", f"{num(3)}-{num(2)}-{num(4)}"), None
    if kind == 30:
        return pick(f"@{word(4, 12)}", f"{word(3, 6)} @ {num(2)}", f"@{word(3, 9)}{num(4)}"), None
    return ("." if rng.random() < 0.5 else " ").join(num(3) for _ in range(rng.integers(3, 8))), None


def planted(texts: list[str], n: int, rng: np.random.Generator) -> list[tuple[str, str | None, int, int]]:
    """n pieces of the texts with a generated string inside: (piece, kind, start, end)."""
    out = []
    while len(out) < n and texts:
        t = texts[rng.integers(len(texts))]
        at = int(rng.integers(len(t))) if t else 0
        made, kind = generated(rng)
        body = t[max(0, at - TRAIN_LENGTH) : at] + (" " if rng.random() < 0.85 else (": ", "(", "\n")[rng.integers(3)])
        out.append((body + made + (" " if rng.random() < 0.7 else (". ", ", ", ")")[rng.integers(3)]) + t[at : at + TRAIN_LENGTH], kind, len(body), len(body) + len(made)))
    return out


def training_windows(texts: list[str], seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Windows of class numbers and tags: around base spans, around generated strings set
    into the texts, and of plain text."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []

    def add(text: str, marks: list[tuple[str, int, int]], middle: int) -> None:
        pad = TRAIN_LENGTH
        x, y = np.full(len(text) + 2 * pad, _BLANK), np.zeros(len(text) + 2 * pad, dtype=np.int64)
        x[pad:-pad] = classes(text)
        for kind, a, b in marks:
            y[pad + a : pad + b] = 1 + KINDS.index(kind)
        a = int(np.clip(pad + middle - rng.integers(pad), 0, len(x) - pad))
        xs.append(x[a : a + pad])
        ys.append(y[a : a + pad])

    spots = [(t, s) for t in texts for s in base_spans(t)]
    for i in rng.permutation(len(spots))[: TRAIN_WINDOWS // 3]:
        t, (_, a, b) = spots[i]
        lo = max(0, a - TRAIN_LENGTH)
        some = t[lo : b + TRAIN_LENGTH]
        add(some, base_spans(some), (a + b) // 2 - lo)
    for _ in range(TRAIN_WINDOWS // 8 if texts else 0):
        t = texts[rng.integers(len(texts))]
        at = int(rng.integers(max(1, len(t))))
        some = t[max(0, at - TRAIN_LENGTH) : at + TRAIN_LENGTH]
        add(some, base_spans(some), len(some) // 2)
    for piece, kind, a, b in planted(texts, TRAIN_WINDOWS - len(xs), rng):
        # a base span that the string is part of, or that is part of it, is no second label
        marks = [m for m in base_spans(piece) if m[2] <= a or m[1] >= b]
        add(piece, marks + ([(kind, a, b)] if kind else []), (a + b) // 2)
    return np.array(xs), np.array(ys)


def train(docs: DataFrame) -> dict | None:
    texts = documents_sample(docs, TRAIN_DOCUMENTS, TRAIN_CHARS)
    return fit(*training_windows(texts)) if texts else None


def holds(kind: str, s: str) -> bool:
    """The test that a decoded span must pass."""
    digits = "".join(c for c in s if c in "0123456789")
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not any(c.isalpha() for c in s)
    if kind == "phone":
        return 10 <= len(digits) <= 15 and not any(c.isalpha() for c in s) and s.count("(") == s.count(")") and s[-1] in "0123456789"
    if kind == "ip":
        try:
            ipaddress.ip_address(s)
        except ValueError:
            return False
        return True
    name, at, host = s.partition("@")
    return bool(name and at) and "@" not in host and all(host.split(".")) and "." in host and not any(c.isspace() for c in s)


def _windowed(flat: np.ndarray) -> np.ndarray:
    """A view (window, place, ...) of the windows at multiples of STEP."""
    n = max(0, (len(flat) - WINDOW) // STEP + 1)
    return np.lib.stride_tricks.as_strided(flat, (n, WINDOW, *flat.shape[1:]), (STEP * flat.strides[0], *flat.strides))


def evidence(texts: list[str], p: dict) -> tuple[np.ndarray, np.ndarray]:
    """(scores, at): (character, tag) scores of all texts end to end; text i has
    scores[at[i]:at[i + 1]].  Every window of every text is computed."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    windows = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STEP)), 0)
    room = np.where(sizes > 0, (windows + 1) * STEP, 0)  # every window begins at a multiple of STEP
    off = np.concatenate([[0], np.cumsum(room)])
    first = np.concatenate([[0], np.cumsum(windows)])
    at = np.concatenate([[0], np.cumsum(sizes)])
    n, k = int(first[-1]), len(p["bo"])
    x, flat = np.full(off[-1], _BLANK, dtype=np.intp), classes("".join(texts))
    for o, a, b in zip(off.tolist(), at.tolist(), at[1:].tolist(), strict=False):
        x[o : o + b - a] = flat[a:b]
    start = np.repeat(off[:-1] // STEP - first[:-1], windows) + np.arange(n)
    weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)
    # of each window what lies before the next one begins, and the rest, which both hold
    own, rest = np.empty((n, STEP, k), dtype=np.float32), np.empty((n, WINDOW - STEP, k), dtype=np.float32)
    seen = _windowed(x)
    some = -(-n // max(1, -(-n // _TOGETHER))) or 1  # of each turn, about the same
    for a in range(0, n, some):
        e = emissions(np.ascontiguousarray(seen[start[a : a + some]].T), p)
        e *= weight[:, None, None]
        _turn(e[:STEP], own[a : a + some])
        _turn(e[STEP:], rest[a : a + some])
    # what the windows that hold a character weigh together, by its place
    follows = np.ones(n, dtype=bool)
    follows[first[:-1][windows > 0]] = False
    follows = np.flatnonzero(follows)
    own[follows, : WINDOW - STEP] += rest[follows - 1]
    share = np.repeat(weight[None, :STEP], 2, axis=0)
    share[1, : WINDOW - STEP] += weight[STEP:]
    one = first[:-1][windows > 0]
    alone = own[one] / share[0][:, None]
    own /= share[1][:, None]
    own[one] = alone
    parts = [np.zeros((0, k), dtype=np.float32)]
    for f, w, size in zip(first.tolist(), windows.tolist(), sizes.tolist(), strict=False):
        if size:
            parts.append(own[f : f + w].reshape(-1, k)[:size])
        if size > w * STEP:
            parts.append(rest[f + w - 1][: size - w * STEP] / weight[STEP : STEP + size - w * STEP, None])
    return np.concatenate(parts), at


def _turn(e: np.ndarray, out: np.ndarray) -> None:
    """Copies (place, window, tag) to (window, place, tag), a character's scores as one item."""
    item = np.dtype((np.void, e.shape[2] * e.itemsize))
    out.view(item)[...] = np.swapaxes(e.view(item), 0, 1)


def _outside(lost: np.ndarray, gain: float) -> np.ndarray:
    """Characters that no run holds whose losses come to at most the gain: the least sum over all
    runs that hold a character comes from running sums, in linear time."""
    c = np.zeros(len(lost) + 1)
    np.cumsum(lost, out=c[1:], dtype=np.float64)
    before = np.maximum.accumulate(c[:-1])
    after = np.minimum.accumulate(c[:0:-1])[::-1]
    return after - before > gain + 1e-6


def anchored(score: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Characters that are outside on every best path.  A run of a tag on a best path beats
    the same run outside, so its evidence must lose less than transitions can gain at its two
    ends; a character that no such run holds, for any tag, is outside.  First for all tags at
    once, by runs that take each character's best tag and gain what any tag gains at most; then
    tag by tag for the rest, in which all other runs lie."""
    k = score.shape[1]
    stay = [trans[y, y] - trans[0, 0] for y in range(k)]
    gain = [0.0] * k
    best = np.full(len(score), -np.inf)
    for y in range(1, k):
        others = [a for a in range(k) if a != y]
        gain[y] = max(0.0, (trans[others, y] - trans[others, 0]).max()) + max(0.0, (trans[y, others] - trans[0, others]).max()) - stay[y]
        np.maximum(best, score[:, y] + stay[y], out=best)
    out = _outside(score[:, 0] - best, max(gain))
    left = ~out
    left[1:] |= ~out[:-1]  # stretches keep a character between them
    left = np.flatnonzero(left)
    rest = score[left]
    sure = np.ones(len(left), dtype=bool)
    for y in range(1, k):
        sure &= _outside(rest[:, 0] - rest[:, y] - stay[y], gain[y])
    out[left[sure]] = True
    return out


def decode(score: np.ndarray, trans: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The best tags of whole texts; stretches between anchored characters are decoded
    beside each other, each with an anchored character at either side."""
    out = np.zeros(len(score), dtype=np.int64)
    free = ~anchored(score, trans)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    spots = np.flatnonzero(free)
    if not len(spots):
        return out
    new = np.concatenate([[True], (np.diff(spots) > 1) | (np.diff(owner[spots]) > 0)])
    begin = spots[new]
    end = np.append(spots[:-1][new[1:]], spots[-1]) + 1
    begin = np.maximum(begin - 1, at[owner[begin]])
    end = np.minimum(end + 1, at[owner[end - 1] + 1])
    n = end - begin
    to = np.concatenate([[0], np.cumsum(n)])
    where = np.repeat(begin - to[:-1], n) + np.arange(to[-1])
    best = viterbi(score[where].astype(np.float64), trans, to)
    out[where[best > 0]] = best[best > 0]  # an anchored character may close two stretches
    return out


def spans_of(text: str, tags: np.ndarray, score: np.ndarray, trans: np.ndarray) -> list[tuple[str, int, int]]:
    """Decoded spans of one text that are sure enough and pass their kind's test."""
    out = []
    edge = np.flatnonzero(np.diff(tags, prepend=0, append=0))
    for b, c in zip(edge.tolist(), edge[1:].tolist(), strict=False):
        y = tags[b]
        if y:
            gain = float((score[b:c, y] - score[b:c, 0]).sum()) + (c - b - 1) * (trans[y, y] - trans[0, 0])
            gain += trans[tags[b - 1], y] - trans[tags[b - 1], 0] if b else 0.0
            gain += trans[y, tags[c]] - trans[0, tags[c]] if c < len(tags) else 0.0
            while c - b > 1 and text[b] in "( ," and text.count("(", b, c) != text.count(")", b, c):
                b += 1  # a bracket around the span is none of it
            if gain >= SURE and holds(KINDS[y - 1], text[b:c]):
                out.append((KINDS[y - 1], b, c))
    return out


def model_spans(texts: list[str], p: dict) -> list[list[tuple[str, int, int]]]:
    """Decoded spans of each text that pass the tests, before base spans are regarded."""
    score, at = evidence(texts, p)
    trans = p["trans"].astype(np.float64)
    tags = decode(score, trans, at)
    out = []
    for t, a, b in zip(texts, at, at[1:], strict=False):
        out.append(spans_of(t, tags[a:b], score[a:b], trans) if tags[a:b].any() else [])
    return out


def viterbi(score: np.ndarray, trans: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The best tags of every stretch at once."""
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    begin, sizes = at[:-1][order], n[order]
    longest = int(sizes[0]) if len(sizes) else 0
    v, back = score.copy(), np.zeros(score.shape, dtype=np.int8)
    for t in range(1, longest):
        k = begin[: int(np.searchsorted(-sizes, -t, side="left"))] + t
        reach = v[k - 1][:, :, None] + trans
        back[k] = reach.argmax(axis=1)
        v[k] = score[k] + reach.max(axis=1)
    out = np.zeros(len(score), dtype=np.int64)
    full = np.flatnonzero(n > 0)
    out[at[1:][full] - 1] = v[at[1:][full] - 1].argmax(axis=1)
    for t in range(longest - 1, 0, -1):
        k = begin[: int(np.searchsorted(-sizes, -t, side="left"))] + t
        out[k - 1] = back[k, out[k]]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def all_spans(texts: list[str | None], p: dict | None) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, by kind as listed, then start."""
    out = []
    plain = [t or "" for t in texts]
    for a, b in slices(plain):
        some = plain[a:b]
        found = model_spans(some, p) if p is not None else [[]] * len(some)
        for t, extra in zip(some, found, strict=True):
            base = base_spans(t)
            edges = [(x, y) for _, x, y in base]
            more = {(k, x, y) for k, x, y in extra if not any(v < y and w > x for v, w in edges)} if extra else set()
            out.append((base, sorted({*base, *more}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


def scan(docs: DataFrame, model: dict | None) -> DataFrame:
    """One row for every row of docs: counts and digest of the base spans, and all spans."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep_freed()
        cols: dict[str, list] = {c: [] for c in (*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_model")}
        for base, every in all_spans(texts_of(batch), model):
            for k in KINDS:
                cols[f"n_{k}"].append(sum(s[0] == k for s in base))
            cols["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            cols["spans"].append(joined(every))
            cols["n_model"].append(len(every) - len(base))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        return pa.record_batch([batch.column(0), *(pa.array(v, k) for v, k in zip(cols.values(), kinds, strict=True))], names=["doc_id", *cols])

    return map_batches(ids_and_texts(docs), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_model long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return scan(docs, train(docs))
