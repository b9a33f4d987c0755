"""Personal data: exact base patterns, and a character BiLSTM with a CRF that adds spans.

The base detectors find plain e-mail addresses, IPs, card and phone numbers.
The model is a bidirectional LSTM over characters with CRF transitions, trained in numpy
on labelled spans: texts made by templates with a fixed seed, which also hold spelled-out forms ("name (at) host (dot) com",
numbers without a plus or with unusual separators) and look-alikes (versions,
dates, tokens). It reads each whole text in windows of ``WINDOW`` characters that overlap; of two windows the one that has a
character nearer to its middle gives its scores. Wherever some span could beat none, the
stretch around it is decoded, over the bounds of those windows; long stretches in pieces that overlap again, each of which answers for
the spans that begin in its middle, so each span is told once and whole.
What it adds has to hold up (digits and their number, the Luhn sum, parts up to 255) and may not overlap a base span.

Defined results: null and empty texts have no spans; offsets are code points, ends
exclusive; rows with equal ids are searched each by itself; texts are searched whole; an empty table gives no rows.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from repograph.llm import kernel as K

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WINDOW, STRIDE = 192, 160
#: A stretch that is decoded reaches so many characters beyond those that may belong to a span.
REACH = 12
#: Stretches longer than this are decoded in pieces that see so many characters more on both sides.
PIECE, SEEN = 128, 96
#: Windows of training.
LEARNT = 64
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) << (k & 1)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def good_ip(s: str) -> bool:
    parts = re.findall("[0-9]+", s)
    return len(parts) == 4 and all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in parts)


def good_card(s: str) -> bool:
    digits = re.sub("[^0-9]", "", s)
    return 13 <= len(digits) <= 19 and luhn(digits)


def good_phone(s: str) -> bool:
    return 9 <= sum(c in "0123456789" for c in s) <= 15


def base_spans(text: str) -> list[Span]:
    """(kind, start, end), leftmost and without overlaps for each kind, sorted."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        m = HOST.match(text, at) if begin < at else None
        if m:
            out.append((0, begin, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for kind, pattern, good in ((1, IP, good_ip), (2, CARD, good_card), (3, PHONE, good_phone)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if good(m[0])]
    return out


# Characters as classes: letters without case, digits as one, some marks.
MARKS = " @._%+-()[]{}<>:,;/\\\n\t\"'#=*|!?&"
_class = np.full(0x110000, 1, np.uint8)
for _c in range(26):
    _class[97 + _c] = _class[65 + _c] = 2 + _c
_class[48:58] = 28
for _k, _c in enumerate(MARKS):
    _class[ord(_c)] = 29 + _k
CLASSES = 29 + len(MARKS)
TAGS = 1 + 2 * len(KINDS)  # none; then begin and inside of each kind


def squashed(x: np.ndarray) -> np.ndarray:
    """Into (-1, 1), in place of tanh, of which it takes a fifth of the time."""
    return x / (1 + np.abs(x))


class Tagger:
    def __init__(self, seed: int = 3, size: int = 8, hidden: int = 10):
        r = np.random.default_rng(seed)
        self.h = hidden
        draw = lambda *shape: (r.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"e": draw(CLASSES, size) * 3, "o": draw(2 * hidden, TAGS), "ob": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p |= {"w" + d: draw(size + hidden, 4 * hidden), "b" + d: np.zeros(4 * hidden, np.float32)}
            self.p["b" + d][hidden : 2 * hidden] = 1

    def _lstm(self, x: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        b, steps, _ = x.shape
        h, c, out, n = np.zeros((b, self.h), np.float32), np.zeros((b, self.h), np.float32), np.empty((b, steps, self.h), np.float32), self.h
        w, bias = self.p["w" + d], self.p["b" + d]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = np.concatenate([x[:, t], h], 1)
            a = z @ w + bias
            s = 0.5 + 0.5 * squashed(a[:, : 3 * n])
            g = squashed(a[:, 3 * n :])
            before = c
            c = s[:, n : 2 * n] * c + s[:, :n] * g
            tc = squashed(c)
            h = s[:, 2 * n :] * tc
            out[:, t] = h
            if keep is not None:
                keep.append((t, z, s, g, before, tc))
        return out

    def scores(self, chars: np.ndarray, keep: dict | None = None) -> np.ndarray:
        x = self.p["e"][chars]
        steps = [[], []] if keep is not None else [None, None]
        h = np.concatenate([self._lstm(x, "f", steps[0]), self._lstm(x, "b", steps[1])], 2)
        if keep is not None:
            keep.update(x=x, h=h, f=steps[0], b=steps[1])
        return h @ self.p["o"] + self.p["ob"]

    def gradient(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Of the CRF's mean negative log likelihood for each character."""
        keep: dict = {}
        s = self.scores(chars, keep).astype(np.float64)
        b, steps, _ = s.shape
        trans = self.p["t"].astype(np.float64)
        up, down = np.empty_like(s), np.zeros_like(s)
        up[:, 0] = s[:, 0]
        for t in range(1, steps):
            up[:, t] = s[:, t] + _lse(up[:, t - 1, :, None] + trans, 1)
        for t in range(steps - 2, -1, -1):
            down[:, t] = _lse(trans + (s[:, t + 1] + down[:, t + 1])[:, None], 2)
        total = _lse(up[:, -1], 1)
        ds = np.exp(up + down - total[:, None, None])
        both = np.exp(up[:, :-1, :, None] + trans + (s[:, 1:] + down[:, 1:])[:, :, None] - total[:, None, None, None])
        dt = both.sum((0, 1))
        row, col = np.arange(b)[:, None], np.arange(steps)[None]
        gold = s[row, col, tags].sum(1) + trans[tags[:, :-1], tags[:, 1:]].sum(1)
        ds[row, col, tags] -= 1
        np.add.at(dt, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
        scale = 1 / (b * steps)
        ds = (ds * scale).astype(np.float32)
        g = {"t": (dt * scale).astype(np.float32), "o": np.einsum("bti,btj->ij", keep["h"], ds), "ob": ds.sum((0, 1))}
        dh = ds @ self.p["o"].T
        dx = np.zeros_like(keep["x"])
        n = self.h
        for d, part in (("f", dh[:, :, :n]), ("b", dh[:, :, n:])):
            w = self.p["w" + d]
            gw, gb = np.zeros_like(w), np.zeros_like(self.p["b" + d])
            later, dc = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
            for t, z, a, u, before, tc in reversed(keep[d]):
                e = part[:, t] + later
                i, f, o = a[:, :n], a[:, n : 2 * n], a[:, 2 * n :]
                dc = dc + e * o * (1 - np.abs(tc)) ** 2
                steep = 0.5 * (1 - np.abs(2 * a - 1)) ** 2
                da = np.concatenate([dc * u * steep[:, :n], dc * before * steep[:, n : 2 * n], e * tc * steep[:, 2 * n :], dc * i * (1 - np.abs(u)) ** 2], 1)
                gw += z.T @ da
                gb += da.sum(0)
                dz = da @ w.T
                dx[:, t] += dz[:, :-n]
                later, dc = dz[:, -n:], dc * f
            g |= {"w" + d: gw, "b" + d: gb}
        ge = np.zeros_like(self.p["e"])
        np.add.at(ge, chars, dx)
        g["e"] = ge
        return float((total - gold).sum() * scale), g

    def emissions(self, chars: np.ndarray) -> np.ndarray:
        """As :meth:`scores`, for many windows, but tags x steps x windows: state, character and bias meet in one product, and what is worked on lies in long rows."""
        n, size = self.h, self.p["e"].shape[1]
        b, steps = chars.shape
        out = np.repeat(self.p["ob"][:, None], steps * b, 1).reshape(TAGS, steps, b)
        a, v, c, u = (np.empty((k * n, b), np.float32) for k in (4, 4, 1, 1))
        # What the gates are made of: twice the state, the character, one for the bias. Halves are left to the weights, exactly.
        z = np.ones((n + size + 1, b), np.float32)
        h, x, letters = z[:n], z[n : n + size], np.ascontiguousarray(self.p["e"].T)
        column = np.ascontiguousarray(chars.T).astype(np.intp)
        for d, o in (("f", self.p["o"][:n]), ("b", self.p["o"][n:])):
            w = self.p["w" + d]
            gates, own = np.ascontiguousarray(np.concatenate([w[-n:] / 2, w[:-n], self.p["b" + d][None]]).T), np.ascontiguousarray(o.T / 2)
            h[:], c[:] = 0, 0
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                np.take(letters, column[t], 1, out=x, mode="clip")
                np.matmul(gates, z, out=a)
                np.abs(a, out=v)
                v += 1
                a /= v
                a[: 3 * n] += 1
                c *= a[n : 2 * n]
                np.multiply(a[:n], a[3 * n :], out=u)
                c += u
                c *= 0.5
                np.abs(c, out=u)
                u += 1
                np.divide(c, u, out=u)
                np.multiply(a[2 * n : 3 * n], u, out=h)
                out[:, t] += own @ h
        return out

    def hopeful(self, s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which characters some span covers that would score more than none. Of scores (tags x characters). Spans don't touch, so the best tags have no other ones."""
        t = self.p["t"].astype(np.float64)
        begin, inside = np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
        out = np.zeros(s.shape[1], bool)
        edge = bounds[1:-1][bounds[1:-1] < s.shape[1]]
        for b, i in zip(begin, inside):
            total, start = np.subtract(s[i], s[0], dtype=np.float64), np.subtract(s[b], s[0], dtype=np.float64)
            # A span of one character has no inside; its own score is looked at beside.
            out |= start > t[0, 0] - t[0, b] + t[0, 0] - t[b, 0]
            total += t[i, i] - t[0, 0]
            total[edge] -= 1e6
            np.cumsum(total, out=total)
            start -= total
            start += t[0, b] - t[0, 0] + t[b, i] - t[i, i]
            np.maximum.accumulate(start, out=start)
            end = total[::-1]
            np.maximum.accumulate(end, out=end)
            total += t[i, 0] - t[0, 0]
            start += total
            out |= start > 0
        return out

    def decode(self, s: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
        """The best tags of each stretch (tags x steps x stretches), of which the first ``size`` steps count: stretches x steps."""
        _, steps, n = s.shape
        size = np.full(n, steps) if size is None else size
        trans = self.p["t"] + _FORBIDDEN
        back, best = np.zeros((steps, TAGS, n), np.int8), s[:, 0].copy()
        best[2::2] -= 1e6
        last = best.copy()
        for t in range(1, steps):
            new = np.empty_like(best)
            for k in range(TAGS):
                m = best + trans[:, k, None]
                back[t, k] = m.argmax(0)
                new[k] = m.max(0) + s[k, t]
            best = new
            last = np.where(t < size, best, last)
        out = np.zeros((n, steps), np.int8)
        rows, tag = np.arange(n), last.argmax(0)
        for t in range(steps - 1, -1, -1):
            inside = t < size
            out[inside, t] = tag[inside]
            tag = np.where(inside, back[t, tag, rows], tag)
        return out


#: Inside of a kind follows only its begin or inside; spans don't touch, so a begin follows none.
_FORBIDDEN = np.zeros((TAGS, TAGS), np.float32)
_FORBIDDEN[1:, 1::2] = -1e6
for _k in range(len(KINDS)):
    _FORBIDDEN[:, 2 + 2 * _k] = -1e6
    _FORBIDDEN[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = 0


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def labelled_text(r: random.Random, dense: bool = True) -> tuple[str, list[Span]]:
    """A text of words with spans and look-alikes among them; few, if not ``dense``."""
    between = r.randrange

    def pick(*x):
        return x[int(r.random() * len(x))]

    def digits(n: int) -> str:
        return str(between(10**n)).zfill(n)

    def word() -> str:
        return "".join(pick("an", "er", "th", "lo", "mi", "ka", "st", "re", "on", "u", "e", "s", "t", "ver", "ç", "ü", "ción", "nd") for _ in range(between(1, 4)))

    def host() -> tuple[str, str]:
        return pick("mail", "post", word(), word() + word() + word(), word() + "-" + word()) + pick("", "", digits(1)), pick("com", "org", "net", "de", "fr", "co.uk", "example.com")

    def email() -> str:
        name = word() + pick("", "." + word(), "." + word() + word(), "." + digits(2), "_" + digits(1), word() + "-" + word())
        a, b = host()
        at, dot = pick(("@", "."), ("@", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("[at]", "."), (" at ", " dot "), (" at ", " dot "), ("(at)", "(dot)"), (" (at) ", "."), (" { at } ", " { dot } "), (" @ ", "."))
        own = name + at + a + dot + b.replace(".", dot)
        return pick(own, own, own.upper(), own.title())

    def ip() -> str:
        return pick(".", ".", " . ", "[.]").join(str(between(256)) for _ in range(4))

    def card() -> str:
        d = str(between(3, 7)) + digits(14)
        d += next(str(k) for k in range(10) if luhn(d + str(k)))
        return pick("", "", " ", "-", ".", "/", " - ").join(d[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"+{digits(1)} ({a}) {b}-{c}", f"+{digits(2)} {a} {b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits(2)} {a} {b}{c}", f"{a} {b} {c}", f"0{a} / {b}{c}", f"{a} - {b} - {c}")

    def decoy() -> str:
        return pick(f"{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}", digits(between(1, 9)), f'token = "{"".join(pick(*"0123456789abcdef") for _ in range(40))}"', f"{digits(2)}:{digits(2)}", f"@{word()}", f"{digits(2)}.{digits(2)} EUR", f"{digits(3)},{digits(3)}", f"look at {word()}")

    text, spans = "", []
    for _ in range(between(8, 16)):
        kind = between(16 if dense else 200)
        if kind < 8:
            own = (email, ip, card, phone)[kind // 2]()
            spans.append((kind // 2, len(text), len(text) + len(own)))
        else:
            own = decoy() if kind < 11 else pick("at", "dot", "a", "in", "is at", word().title()) if kind == 11 else word()
        text += own + pick(" ", " ", " ", ". ", ", ", "\n", "!! ", " | ")
    return text, spans


WEIGHTS = Path(__file__).with_name("pii_weights.json")


@lru_cache(1)
def trained() -> Tagger:
    """The model that ``python -m repograph.llm.pii`` has made by :func:`train`."""
    m = Tagger()
    m.p = {k: np.array(v, np.float32) for k, v in json.loads(WEIGHTS.read_text()).items()}
    return m


def train(steps: int = 2500, batch: int = 64, seed: int = 11) -> Tagger:
    """The model of :func:`labelled_text` by Adam; the same draws each time."""
    r, m = random.Random(seed), Tagger()
    first = {k: np.zeros_like(v) for k, v in m.p.items()}
    second = {k: np.zeros_like(v) for k, v in m.p.items()}
    for step in range(1, steps + 1):
        chars, tags = np.zeros((batch, LEARNT), np.uint8), np.zeros((batch, LEARNT), np.int64)
        for i in range(batch):
            text, spans = labelled_text(r, i % 3 > 0)
            tag = np.zeros(len(text), np.int64)
            for kind, a, b in spans:
                tag[a:b], tag[a] = 2 + 2 * kind, 1 + 2 * kind
            a = r.randrange(max(1, len(text) - LEARNT))
            own = classes(text)[a : a + LEARNT]
            chars[i, : len(own)], tags[i, : len(own)] = own, tag[a : a + LEARNT]
        _, g = m.gradient(chars, tags)
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = 0.015 * min(1, 1.3 * (1 - step / (steps + 1)))
        for k, x in g.items():
            x = x / max(1.0, norm)
            first[k] += 0.1 * (x - first[k])
            second[k] += 0.01 * (x * x - second[k])
            m.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return m


def classes(text: str) -> np.ndarray:
    return _class[np.frombuffer(text.encode("utf-32-le"), np.uint32)]


def reconciled(m: Tagger, chars: np.ndarray, bounds: np.ndarray, batch: int = 1024) -> np.ndarray:
    """Scores (tags x characters) of the texts: each character's come from the window that has it nearest to its middle.

    Texts are laid out with blanks of half an overlap before and after them, so that a window answers for the
    ``STRIDE`` characters in its middle and sees no other text.
    """
    half, size = (WINDOW - STRIDE) // 2, np.diff(bounds)
    room = -(-(size + 2 * half) // STRIDE) * STRIDE
    begin = np.concatenate([[0], np.cumsum(room)])
    slots = np.zeros(begin[-1] + 2 * half, np.uint8)
    at = np.arange(len(chars)) + np.repeat(begin[:-1] + half - bounds[:-1], size)
    slots[at + half] = chars
    windows = np.lib.stride_tricks.sliding_window_view(slots, WINDOW)[::STRIDE]
    out = np.empty((TAGS, begin[-1]), np.float32)
    for k in range(0, len(windows), batch):
        own = m.emissions(windows[k : k + batch])[:, half : half + STRIDE]
        out[:, k * STRIDE : k * STRIDE + own.shape[1] * own.shape[2]] = own.transpose(0, 2, 1).reshape(TAGS, -1)
    inside = np.zeros(begin[-1], bool)
    inside[at] = True
    return out[:, inside]


def stretches(may: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the runs of the marked characters with those around them; none crosses a bound."""
    may = np.flatnonzero(may)
    if not len(may):
        return may, may
    text = np.searchsorted(bounds, may, "right") - 1
    first, last = np.maximum(may - REACH, bounds[text]), np.minimum(may + REACH + 1, bounds[text + 1])
    new = np.r_[True, (first[1:] > last[:-1]) | (text[1:] != text[:-1])]
    return first[new], last[np.r_[new[1:], True]]


def _to_words(text: str, a: int, b: int) -> tuple[int, int]:
    """The span without marks at its ends, grown over the rest of the words and numbers that it cuts."""
    while a < b and text[a] in " .,;:\n":
        a += 1
    while a < b and text[b - 1] in " .,;:-\n":
        b -= 1
    if a < b:
        while a and text[a].isalnum() and text[a - 1] in LOCAL:
            a -= 1
        while b < len(text) and text[b - 1].isalnum() and (text[b].isalnum() or (text[b] in "-_" and text[b + 1 : b + 2].isalnum())):
            b += 1
    return a, b


def telling(chars: np.ndarray) -> np.ndarray:
    """Digits, @, and the a of "at" with no letter beside it."""
    letter = (chars >= 1) & (chars < 28)
    at = np.zeros(len(chars), bool)
    at[:-1] = (chars[:-1] == 2) & (chars[1:] == 21)
    at[1:] &= ~letter[:-1]
    at[:-2] &= ~letter[2:]
    return at | (chars == 28) | (chars == _class[ord("@")])


def model_spans(m: Tagger, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """What the model adds to each text's base spans."""
    found: list[list[Span]] = [[] for _ in texts]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    if not bounds[-1]:
        return found
    chars = np.concatenate([classes(t) for t in texts])
    s = reconciled(m, chars, bounds)
    first, last = stretches(m.hopeful(s, bounds), bounds)
    # A stretch without a digit, an @ or the word "at" has nothing that holds up.
    signs = np.concatenate([[0], np.cumsum(telling(chars))])
    able = signs[last] > signs[first]
    first, last = first[able], last[able]
    # Long stretches are decoded in pieces that overlap; a piece answers for the spans that begin in its middle.
    count = np.maximum(1, -(-(last - first) // PIECE))
    begin = np.repeat(first, count) + K.within(count) * PIECE
    end = np.minimum(begin + PIECE, np.repeat(last, count))
    first, last = np.maximum(begin - SEEN, np.repeat(first, count)), np.minimum(end + SEEN, np.repeat(last, count))
    order = np.argsort(last - first, kind="stable")
    for k in range(0, len(order), 4096):
        own = order[k : k + 4096]
        size = last[own] - first[own]
        at = first[own, None] + np.arange(size.max())
        tags = m.decode(np.ascontiguousarray(s[:, np.minimum(at, s.shape[1] - 1).T]), size)
        starts = np.argwhere((tags > 0) & (tags % 2 == 1) & (at >= begin[own, None]) & (at < end[own, None]))
        for row, x in starts:
            y, inner = x + 1, tags[row, x] + 1
            while y < size[row] and tags[row, y] == inner:
                y += 1
            i = int(np.searchsorted(bounds, first[own[row]], "right")) - 1
            a, b = int(first[own[row]] + x - bounds[i]), int(first[own[row]] + y - bounds[i])
            a, b = _to_words(texts[i], a, b)
            found[i].append(((int(tags[row, x]) - 1) // 2, a, b))
    return [sorted({s for s in own if s[1] < s[2] and _holds(texts[i][s[1] : s[2]], s[0]) and not any(s[1] < b and a < s[2] for _, a, b in base[i])}) for i, own in enumerate(found)]


def _holds(s: str, kind: int) -> bool:
    if s != s.strip():
        return False
    if kind == 0:
        return bool(re.fullmatch(r"[\w.%+-]+(?: ?[(\[{] ?at ?[)\]}] ?| at | ?@ ?)[\w-]+(?:(?: ?[(\[{] ?dot ?[)\]}] ?| dot |\.)[\w-]+)*(?: ?[(\[{] ?dot ?[)\]}] ?| dot |\.)[A-Za-z]{2,}", s, re.I))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(?:(?: ?\. ?|\[\.\])[0-9]{1,3}){3}", s)) and good_ip(s)
    if kind == 2:
        return bool(re.fullmatch(r"[0-9]{4}(?:[ ./-]{1,3}[0-9]{4}){3}|[0-9]{4}[ ./-]{1,3}[0-9]{6}[ ./-]{1,3}[0-9]{5}", s)) and good_card(s)
    return bool(re.fullmatch(r"(?:\+|00)?[0-9 ]{0,4}\(?[0-9]{2,4}\)?(?:[ ./-]{1,3}[0-9]{2,7}){1,4}", s)) and good_phone(s)


def find(docs: DataFrame) -> DataFrame:
    """Of (doc_id, text): doc_id, base and added: arrays of (kind, first, last), each sorted by kind, then place."""
    sent = docs.sparkSession.sparkContext.broadcast(trained())
    span = "array<struct<kind:string,first:long,last:long>>"

    def told(spans: list[list[Span]]) -> pa.Array:
        return pa.array([[{"kind": KINDS[k], "first": a, "last": b} for k, a, b in sorted(own)] for own in spans], pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in K.slices(batches, "text"):
            texts = [t.text(i).decode() for i in range(len(t))]
            base = [base_spans(x) for x in texts]
            yield pa.RecordBatch.from_arrays([t.keys.column(0), told(base), told(model_spans(sent.value, texts, base))], names=["doc_id", "base", "added"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, base {span}, added {span}")


if __name__ == "__main__":
    WEIGHTS.write_text(json.dumps({k: np.round(v.astype(float), 3).tolist() for k, v in train().p.items()}, separators=(",", ":")) + "\n")
