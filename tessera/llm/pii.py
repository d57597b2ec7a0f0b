"""Personal data (operator 7).

Plain patterns find the well-formed emails, addresses, card numbers and phone numbers. A semi-Markov conditional random
field adds the forms they miss (spelled-out emails, national phone numbers, cards with other separators): features of whole
spans score all segments of up to MAX_TOKENS tokens in the wide stretches around digits and spelled-out at-signs, and a
dynamic program over these segments chooses boundaries and types together. The field is trained here, on sentences drawn
from templates with a fixed seed.

Scale: one pass in the scan's tasks, no shuffle; the model is a few hundred numbers. Features are differences of running sums
over a window of tokens at a time, so time and memory are linear in the text, however many digits it has.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, documents, rows_of

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits can only be entered at its start: what follows a failure there fails for the rest of the run as well.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email pattern: from every @ back over the local part, which holds no @, in linear time."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(last, at + 1))


def base_spans(text: str) -> list[Span]:
    """The spans of the plain patterns, by kind and start."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


# ---- candidate stretches -------------------------------------------------------------------------------------------

MAX_TOKENS = 16
#: Tokens whose spans are scored at once.
WINDOW = 1024
REACH = 64
_TOKEN = re.compile(r"[A-Za-z0-9_%]+|[^\sA-Za-z0-9_%]")
#: Digits at most three separators apart, and a spelled-out at-sign.
_NUMERIC = re.compile(r"[+(]?[0-9](?:[0-9]|[^\w\n]{1,3}(?=[0-9])|_(?=[0-9]))*")
_AT = re.compile(r"(?:(?<=[\s\[({])|(?<=[a-z0-9][\[({]))(?:at|AT|At)(?=[\s\])}])")
_DOT = re.compile(r"(?<![A-Za-z])(?:dot|DOT|Dot)(?![A-Za-z])|[A-Za-z0-9]\.[a-z]")


def stretches(text: str) -> list[tuple[int, int]]:
    """The candidate stretches of a text where segments may lie, in order and apart from each other; all else is outside. They
    are drawn wide, words around a spelled-out address included: what is in them is the field's choice."""
    found: list[tuple[int, int]] = []
    if _DIGIT.search(text):
        found += [m.span() for m in _NUMERIC.finditer(text) if m.end() - m.start() >= 7]
    if "at" in text or "AT" in text or "At" in text:
        for m in _AT.finditer(text):
            d = _DOT.search(text, m.end(), min(len(text), m.end() + REACH))
            if d:
                a, b = max(0, m.start() - REACH), min(len(text), d.end() + REACH)
                cut, stop = text.rfind("\n", a, m.start()), text.find("\n", d.end(), b)
                found.append((cut + 1 if cut >= 0 else a, stop if stop >= 0 else b))
        found.sort()
    out: list[tuple[int, int]] = []
    for a, b in found:
        # A cut at REACH must not fall into a word.
        while a > 0 and text[a - 1].isalnum() and text[a].isalnum():
            a -= 1
        while b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FEATURE_NAMES = (
    "bias", "digits<7", "digits7-9", "digits10-11", "digits12", "digits13-16", "digits17-19", "digits>19", "luhn", "groups3-4", "group=4x4", "plus", "parenthesis", "dots3",
    "separators", "letters", "at", "at then dot", "glued", "word before", "cut digits", "one group", "mixed separators", "long group", "ends in marker", "card of one group",
    "words before at", "words after dot", "starts in marker", "wide gap", "begins with 00", "one word after dot", "comma",
)
#: Words that announce personal data; they are a feature, not a condition.
ANNOUNCING = frozenset("tel telephone phone call fax mobile cell card visa mastercard amex mail email contact".split())
_SEPARATORS = "-./_ "


class Stretch:
    """A stretch's tokens and running sums over them, from which the features of any whole span are differences."""

    def __init__(self, text: str, a: int, b: int) -> None:
        self.tokens = [m.span() for m in _TOKEN.finditer(text, a, b)]
        tokens, n = self.tokens, len(self.tokens)
        if not n:
            return
        c = np.frombuffer(text[a:b].encode("utf-32-le", "surrogatepass"), np.uint32)
        start = np.array([x for x, _ in tokens]) - a
        end = np.array([y for _, y in tokens]) - a
        self.start, self.end = start, end
        total = lambda hit: np.concatenate([[0], np.cumsum(hit)])
        digit = (c >= 48) & (c <= 57)
        lower = c | 32
        self.digits, self.alpha = total(digit), total((lower >= 97) & (lower <= 122) | (c > 191))
        self.kinds = [total(c == ord(x)) for x in _SEPARATORS] + [total(~digit & ~((lower >= 97) & (lower <= 122)) & ~np.isin(c, [ord(x) for x in _SEPARATORS + "()+"]))]
        self.opened, self.shut = total(c == 40), total(c == 41)
        # Runs of digits.
        edge = np.diff(np.concatenate([[0], digit.astype(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.run = last - first
        self.runs_before, self.runs_until = np.searchsorted(first, start), np.searchsorted(last, end, side="right")
        self.fours, self.long = total(self.run == 4), total(self.run > 4)
        # Digits at even and odd places, plain and doubled as Luhn's sum takes them.
        d = (c[digit] - 48).astype(np.int64)
        twice = np.where(d > 4, 2 * d - 9, 2 * d)
        odd = np.arange(len(d)) % 2 == 1
        self.luhn = [total(np.where(odd == bool(k), d, twice)) for k in (0, 1)]
        words = [text[x:y].lower() for x, y in tokens]
        at = np.array([w in ("at", "@") for w in words])
        dot = np.array([w in ("dot", ".") for w in words])
        self.marker = at | np.array([w == "dot" for w in words])
        place = np.arange(n)
        self.next_at = np.minimum.accumulate(np.where(at, place, n)[::-1])[::-1]
        self.last_dot = np.maximum.accumulate(np.where(dot, place, -1))
        spaced = np.array([x > a and text[x - 1].isspace() and text[x].isalnum() for x, _ in tokens])
        self.words = total(spaced)
        self.commas = total(np.array([w in (",", ";") for w in words]))
        self.zeros = (c[start] == 48) & (c[np.minimum(start + 1, len(c) - 1)] == 48)
        self.plus = c[start] == 43
        alnum = lambda x: (x >= 48) & (x <= 57) | ((x | 32) >= 97) & ((x | 32) <= 122) | (x > 191)
        self.opens = alnum(c[start]) | self.plus | (c[start] == 40)
        self.closes = alnum(c[end - 1])
        around = np.array([(x > 0 and text[x - 1].isalnum(), y < len(text) and text[y].isalnum()) for x, y in tokens])
        self.glued_before, self.glued_after = around[:, 0], around[:, 1]
        digit_at = lambda i: 0 <= i < len(text) and "0" <= text[i] <= "9"
        self.cut_before = np.array([digit_at(x - 1) or x > 1 and text[x - 1] in " ().+-" and digit_at(x - 2) for x, _ in tokens])
        self.cut_after = np.array([digit_at(y) or y < len(text) and text[y] in " ().+-" and digit_at(y + 1) for _, y in tokens])
        announced, last_word = [], text[max(0, a - 16) : a].lower().replace(":", " ").split()[-1:]
        for w in words:
            announced.append(bool(last_word) and last_word[0] in ANNOUNCING)
            last_word = [w] if w.isalnum() else last_word
        self.announced = np.array(announced)

    def spans(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """First token and end of the possible spans that begin at tokens lo..hi-1: they begin with a digit, a letter, + or (, end
        with a digit or a letter, and hold seven digits or a spelled-out at-sign with words around it."""
        n = len(self.tokens)
        i = np.repeat(np.arange(lo, hi), MAX_TOKENS)
        j = i + np.tile(np.arange(1, MAX_TOKENS + 1), hi - lo)
        ok = j <= n
        i, j = i[ok], j[ok]
        digits = self.digits[self.end[j - 1]] - self.digits[self.start[i]]
        spelled = (self.next_at[i] < j - 1) & (self.next_at[i] > i) & (j - i >= 4)
        ok = self.opens[i] & self.closes[j - 1] & ((digits >= 7) | spelled)
        return i[ok], j[ok]

    def features(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """A row of FEATURE_NAMES for each span of tokens i..j-1."""
        a, b = self.start[i], self.end[j - 1]
        within = lambda sums: sums[b] - sums[a]
        n = within(self.digits)
        r0, r1 = self.runs_before[i], self.runs_until[j - 1]
        groups = np.maximum(0, r1 - r0)
        run = np.concatenate([self.run, [0, 0]])
        parity = (self.digits[b] - 1) % 2
        checked = np.where(parity == 1, self.luhn[1][self.digits[b]] - self.luhn[1][self.digits[a]], self.luhn[0][self.digits[b]] - self.luhn[0][self.digits[a]])
        luhn_ok = (n >= 13) & (checked % 10 == 0)
        at, dot = self.next_at[i], self.last_dot[j - 1]
        has_at, spelled = at < j, (at < j) & (dot > at)
        # Words of their own between the first one and the at-sign, and after the one that follows the last dot.
        before = self.words[np.minimum(at, len(self.tokens))] - self.words[i + 1]
        after = np.where(spelled, j - 1 - dot, 0)
        kinds = sum((within(k) > 0).astype(np.int8) for k in self.kinds)
        f = [
            np.ones(len(i)), n < 7, (n >= 7) & (n <= 9), (n >= 10) & (n <= 11), n == 12, (n >= 13) & (n <= 16), (n >= 17) & (n <= 19), n > 19, luhn_ok,
            (groups >= 2) & (run[r1 - 1] == 4) & (run[r1 - 2] == 3), (groups == 4) & (self.fours[r1] - self.fours[np.minimum(r0, r1)] == 4), self.plus[i], (within(self.opened) > 0) & (within(self.shut) > 0),
            (within(self.kinds[1]) == 3) & (groups == 4), groups > 1, within(self.alpha) > 0, has_at, spelled, self.glued_before[i] | self.glued_after[j - 1], self.announced[i],
            self.cut_before[i] | self.cut_after[j - 1], groups == 1, kinds > 2, self.long[r1] - self.long[np.minimum(r0, r1)] > 0, self.marker[j - 1], (groups == 1) & (n == 16) & luhn_ok,
            has_at & (before > 0), after > 1, self.marker[i], (b - a) - within(self.alpha) - n > 2 * (j - i), self.zeros[i], after == 1, self.commas[j] - self.commas[i] > 0,
        ]
        return np.stack([np.asarray(x, dtype=float) for x in f], axis=1)


class Lattice:
    """All segments of a short stretch, as the training needs them: outside tokens and possible spans with features."""

    def __init__(self, text: str, a: int, b: int) -> None:
        s = Stretch(text, a, b)
        self.tokens = s.tokens
        i, j = s.spans(0, len(s.tokens)) if s.tokens else (np.zeros(0, int), np.zeros(0, int))
        self.spans = list(zip(i.tolist(), j.tolist(), strict=True))
        self.features = s.features(i, j) if len(i) else np.zeros((0, len(FEATURE_NAMES)))


def _logsum(x: list[float]) -> float:
    top = max(x)
    return top + float(np.log(np.sum(np.exp(np.array(x) - top)))) if top > -np.inf else top


class SemiMarkov:
    """Weights by kind and feature; an outside token scores 0."""

    def __init__(self, weights: np.ndarray) -> None:
        self.w = weights

    def decode(self, stretch: Stretch, window: int = WINDOW) -> list[tuple[int, int, str]]:
        """The best segmentation: (first token, end, kind) of its entities.

        Spans are scored a window of first tokens at a time, and one that scores no more than its tokens outside would is never
        in the best segmentation, so what is held is linear in the tokens, and small."""
        n = len(stretch.tokens)
        best, back = np.zeros(n + 1), {}
        pending: dict[int, list[tuple[int, float, int]]] = {}
        for lo in range(0, n, window):
            hi = min(n, lo + window)
            i, j = stretch.spans(lo, hi)
            if len(i):
                scores = stretch.features(i, j) @ self.w.T
                kind = scores.argmax(axis=1)
                top = scores[np.arange(len(i)), kind]
                for k in np.flatnonzero(top > 0).tolist():
                    pending.setdefault(int(j[k]), []).append((int(i[k]), float(top[k]), int(kind[k])))
            # Every span that ends here has begun before hi.
            at = lo
            for e in sorted(x for x in pending if x <= hi):
                best[at + 1 : e + 1] = best[at]
                for first, score, y in pending.pop(e):
                    if best[first] + score > best[e]:
                        best[e], back[e] = best[first] + score, (first, y)
                at = e
            best[at + 1 : hi + 1] = best[at]
        out, j = [], n
        ends = sorted(back)
        while ends:
            e = ends.pop()
            if e > j:
                continue
            i, y = back[e]
            out.append((i, e, KINDS[y]))
            j = i
        return out[::-1]

    def gradient(self, lattice: Lattice, gold: list[tuple[int, int, str]]) -> tuple[float, np.ndarray]:
        """Log-likelihood of a segmentation and its gradient, by the forward and backward sums over segments."""
        n = len(lattice.tokens)
        scores = lattice.features @ self.w.T
        starting: dict[int, list[int]] = {}
        ending: dict[int, list[int]] = {}
        for k, (i, j) in enumerate(lattice.spans):
            starting.setdefault(i, []).append(k)
            ending.setdefault(j, []).append(k)
        whole = [_logsum(list(row)) for row in scores]
        fwd, bwd = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            fwd[j] = _logsum([fwd[j - 1], *(fwd[lattice.spans[k][0]] + whole[k] for k in ending[j])]) if j in ending else fwd[j - 1]
        for i in range(n - 1, -1, -1):
            bwd[i] = _logsum([bwd[i + 1], *(bwd[lattice.spans[k][1]] + whole[k] for k in starting[i])]) if i in starting else bwd[i + 1]
        first, end = np.array([i for i, _ in lattice.spans]), np.array([j for _, j in lattice.spans])
        chance = np.exp(np.array(fwd)[first][:, None] + scores + np.array(bwd)[end][:, None] - fwd[n]) if len(first) else scores
        grad, value = -chance.T @ lattice.features, -fwd[n]
        at = {s: k for k, s in enumerate(lattice.spans)}
        for i, j, kind in gold:
            k, y = at[i, j], KINDS.index(kind)
            value += scores[k, y]
            grad[y] += lattice.features[k]
        return value, grad


def templates(seed: int = 11, each: int = 16) -> list[tuple[str, list[Span]]]:
    """Training sentences with the spans in them: forms that the plain patterns miss, and look-alikes without personal data."""
    r = np.random.default_rng(seed)
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    word = lambda: "".join(r.choice(list("abcdefghijklmnoprstuvwz"), int(r.integers(3, 9))))

    def card(sep: str) -> str:
        body = digits(15)
        d = next(body + c for c in "0123456789" if luhn(body + c))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def failing() -> str:
        d = digits(16)
        return d if not luhn(d) else d[:-1] + str((int(d[-1]) + 1) % 10)

    mixed = [
        lambda: [("phone", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}"), ("card", card(""))], lambda: [("card", card("")), ("card", card(""))], lambda: [("card", card("")), (None, digits(2))],
        lambda: [("phone", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}"), (None, failing())], lambda: [("card", card("")), ("phone", f"({digits(3)}) {digits(3)}-{digits(4)}")],
    ]
    positive = [
        ("phone", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"), ("phone", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}"), ("phone", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}"),
        ("phone", lambda: f"00{digits(2)} {digits(3)} {digits(3)} {digits(4)}"), ("phone", lambda: f"1-{digits(3)}-{digits(3)}-{digits(4)}"),
        ("card", lambda: card(".")), ("card", lambda: card("/")), ("card", lambda: card("_")),
        ("email", lambda: f"{word()} at {word()} dot com"), ("email", lambda: f"{word()}.{word()} [at] {word()} [dot] org"), ("email", lambda: f"{word()}(at){word()}.net"), ("email", lambda: f"{word()} (at) {word()} (dot) com"),
    ]
    negative = [
        lambda: f"{word()} looked at the {word()} dot on {word()}", lambda: f"{word()} at noon. {word()}", lambda: f"meet {word()} at {word()}.{word()} {word()}", lambda: " ".join(digits(2) for _ in range(9)), lambda: ", ".join(digits(4) for _ in range(4)),
        lambda: " ".join(digits(1) for _ in range(10)), lambda: f"{digits(3)},{digits(3)},{digits(3)}.{digits(2)}", lambda: f"{word()} at the dot com {word()}",
        failing, lambda: failing(), lambda: digits(20), lambda: digits(8), lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"{digits(3)}.{digits(3)}.{digits(3)}.999",
        lambda: f"{digits(2)}/{digits(2)}/{digits(4)}", lambda: f"{digits(7)}", lambda: f"{digits(10)}", lambda: f"{digits(4)} {digits(4)}", lambda: f"{digits(12)}", lambda: f"{digits(3)} {digits(3)} {digits(3)}", lambda: f"{word()} (at) {word()}",
    ]
    out: list[tuple[str, list[Span]]] = []
    for _ in range(each):
        for kind, make in positive:
            left, x, right = " ".join(word() for _ in range(int(r.integers(1, 4)))) + " ", make(), str(r.choice([" ", ", "])) + " ".join(word() for _ in range(int(r.integers(1, 4)))) + "."
            out.append((left + x + right, [(kind, len(left), len(left) + len(x))]))
        for make in mixed:
            text, spans = word(), []
            for kind, x in make():
                spans += [(kind, len(text) + 1, len(text) + 1 + len(x))] if kind else []
                text += " " + x
            out.append((text + " " + word(), spans))
        for make in negative:
            out.append((f"{word()} {make()} {word()}.", []))
    return out


@lru_cache(maxsize=1)
def trained(steps: int = 160, rate: float = 0.25, penalty: float = 1e-3) -> SemiMarkov:
    """The field fitted to the templates by Adam on the penalised log-likelihood."""
    data = []
    for text, gold in templates():
        for a, b in stretches(text):
            lattice = Lattice(text, a, b)
            if not lattice.spans:
                continue
            at = {(lattice.tokens[i][0], lattice.tokens[j - 1][1]): (i, j) for i, j in lattice.spans}
            want = [(*at[s, e], kind) for kind, s, e in gold if (s, e) in at]
            data.append((lattice, want))
    model = SemiMarkov(np.zeros((len(KINDS), len(FEATURE_NAMES))))
    m, v = np.zeros_like(model.w), np.zeros_like(model.w)
    for t in range(1, steps + 1):
        grad = -penalty * len(data) * model.w
        for lattice, gold in data:
            grad += model.gradient(lattice, gold)[1]
        grad /= len(data)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        model.w = model.w + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return model


def _between(parts: list[tuple[int, int]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts without what taken spans cover; both sorted, the parts apart from each other."""
    at = 0
    reach = 0
    for a, b in parts:
        a = max(a, min(reach, b))
        while at < len(taken) and taken[at][0] < b:
            x, y = taken[at]
            if y > a:
                if x > a:
                    yield a, x
                a = max(a, y)
            reach = max(reach, y)
            at += 1
        if a < b:
            yield a, b


def all_spans(text: str, model: SemiMarkov) -> tuple[list[Span], list[Span]]:
    """The plain patterns' spans, and these with the field's spans that overlap none of them; both by kind, then start."""
    base = base_spans(text)
    added: list[Span] = []
    for a, b in _between(stretches(text), sorted((a, b) for _, a, b in base)):
        s = Stretch(text, a, b)
        if s.tokens:
            added += [(kind, s.tokens[i][0], s.tokens[j - 1][1]) for i, j, kind in model.decode(s)]
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted({*base, *added}, key=lambda s: (order[s[0]], s[1], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _find(weights: np.ndarray):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SemiMarkov(weights)
        for batch in rows_of(batches):
            found = [all_spans(x.decode("utf-8", "replace"), model) for x in batch.column(batch.num_columns - 1).to_pylist()]
            cols = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in row[w]] for row in found], _SPAN) for w in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], [*batch.schema.names[:-1], "base", "spans"])

    return kernel


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end in code points, end exclusive) for every row of docs.

    Null and empty texts have none. Spans of different kinds may overlap as the patterns find them; the field adds none
    that overlaps one of those. Repeated rows and null ids stay; other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("text"))
    spans = "array<struct<kind:string,start:int,end:int>>"
    return slim.mapInArrow(_find(trained().w), f"doc_id bigint, base {spans}, spans {spans}")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out.append(text[at:a] + f"<{kind}>")
        at = max(at, b)
    return "".join(out) + text[at:]


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return find(documents(spark, sf_dir)).select("doc_id", *map(number, KINDS), F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
