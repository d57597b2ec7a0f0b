"""Tokenization: the rule tokenizer (prefixes, suffixes, infixes, exceptions, URLs) and a regular-expression one.

The rule tokenizer takes its language data as TokenizerRules; `tokenize_regex` needs none and runs inside Catalyst.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import cached_property
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import UnsupportedError
from ..functions.lexical import Lexicon, norm
from ..schema import DOC, DOC_DDL, with_doc_columns
from .kernels import per_document

#: The token classes of tokenize_regex: letters, numbers, and single other characters that are not white space.
REGEX = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"


def tokenize_regex(docs: DataFrame, pattern: str = REGEX) -> DataFrame:
    """doc_id, i, text of a simplified tokenization, as expressions alone; not the rule tokenizer."""
    words = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0))
    return docs.select("doc_id", F.posexplode(words).alias("i", "text"))


def tokenize_regex_ahead(docs: DataFrame, ahead: int, pattern: str = REGEX) -> DataFrame:
    """doc_id, i, text, next1 .. of tokenize_regex, where next<k> is the token k places on, null past the end. The tokens
    ahead come from the document's own array, so looking ahead needs neither a shuffle nor a sort."""
    words = docs.select("doc_id", F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0)).alias("w"))
    rest = [F.slice("w", F.lit(1 + k), F.greatest(F.size("w") - k, F.lit(0))).alias(f"next{k}") for k in range(1, ahead + 1)]
    return words.select("doc_id", F.posexplode(F.arrays_zip(F.col("w").alias("text"), *rest)).alias("i", "t")).select("doc_id", "i", "t.*")


def tokenize_regex_docs(docs: DataFrame, pattern: str = r"[^\W\d_]+|\d+|[^\s\w]|_") -> DataFrame:
    """Documents of the model tokenized by a regular expression; white space that is not one blank after a token is a token."""

    def run(d: dict) -> list[dict]:
        text = d["text"] or ""
        pieces, at = [], 0
        for m in re.finditer(pattern, text):
            if m.start() > at:
                pieces.append((at, m.start()))
            pieces.append(m.span())
            at = m.end()
        if at < len(text):
            pieces.append((at, len(text)))
        return [dict.fromkeys(DOC) | {"doc_id": d["doc_id"], "text": text, "tokens": _records(text, _blanks(text, pieces), Lexicon()), "tensor": [], "span_groups": []}]

    return per_document(docs.select("doc_id", "text"), run, DOC_DDL)


def _blanks(text: str, pieces: list[tuple[int, int]]) -> list[tuple[int, int, bool, str | None]]:
    """Pieces with a following single blank taken as the token's white space."""
    out: list[tuple[int, int, bool, str | None]] = []
    for a, b in pieces:
        if text[a] == " " and out and not text[out[-1][0] : out[-1][1]].isspace() and out[-1][1] == a and not out[-1][2]:
            x, y, _, n = out[-1]
            out[-1] = (x, y, True, n)
            a += 1
        if a < b:
            out.append((a, b, False, None))
    return out


def _records(text: str, pieces: list[tuple[int, int, bool, str | None]], lexicon: Lexicon) -> list[dict]:
    """Token records from code-point pieces (start, end, blank after, norm)."""
    out, byte, at = [], 0, 0
    empty = dict.fromkeys(("tag", "pos", "morphology", "lemma", "head", "dep", "sentence_start", "entity_iob", "entity_type", "entity_id"))
    for a, b, blank, given in pieces:
        byte += len(text[at:a].encode())
        size = len(text[a:b].encode())
        word = text[a:b]
        out.append({"start": byte, "end": byte + size, "idx": a, "whitespace": blank, "norm": norm(word, lexicon) if given is None else given, **empty})
        byte, at = byte + size, b
    return out


@dataclass(frozen=True)
class TokenizerRules:
    """Language data: expressions for prefixes, suffixes, infixes and URLs, and exceptions (text -> (orth, norm) pieces)."""

    prefix: str = r"[\(\[\{\"'“‘<$£€#]"
    suffix: str = r"[\)\]\}\"'”’>,.;:!?%…]|'s|’s"
    infix: str = r"\.\.+|…|(?<=[a-zA-Z])[-–—/](?=[a-zA-Z])|(?<=[a-z])\.(?=[A-Z])"
    url: str = r"(?:https?://|www\.)\S+"
    exceptions: Mapping[str, tuple[tuple[str, str | None], ...]] = field(default_factory=dict)
    lexicon: Lexicon = field(default_factory=Lexicon)

    def __post_init__(self) -> None:
        for text, pieces in self.exceptions.items():
            if "".join(p for p, _ in pieces) != text.replace(" ", "") and "".join(p for p, _ in pieces) != text:
                raise UnsupportedError(f"the pieces of {text!r} don't make it up")


class RuleTokenizer:
    def __init__(self, rules: TokenizerRules) -> None:
        self.rules = rules
        self.prefix = re.compile(rf"^(?:{rules.prefix})")
        self.suffix = re.compile(rf"(?:{rules.suffix})$")
        self.infix = re.compile(rules.infix)
        self.url = re.compile(rf"(?:{rules.url})\Z")

    @cached_property
    def sequences(self) -> dict[str, list[list[str]]]:
        """What plain splitting makes of the exceptions that it takes apart, by its first token."""
        apart = lambda text: " " in text or any(p.search(text) for p in (self.prefix, self.suffix, self.infix))
        made = [[text[a:b] for a, b, *_ in self.split(text, exceptions=False)] for text in filter(apart, self.rules.exceptions)]
        by_first: dict[str, list[list[str]]] = {words[0]: [] for words in made if words}
        for words in filter(None, made):
            by_first[words[0]].append(words)
        return by_first

    def split(self, text: str, exceptions: bool = True) -> list[tuple[int, int, bool, str | None]]:
        """Stretches of white space and of other characters; the first blank after a word belongs to the word."""
        out: list[tuple[int, int, bool, str | None]] = []
        for _, run in groupby(range(len(text)), key=lambda i: text[i].isspace()):
            at = list(run)
            a, end = at[0], at[-1] + 1
            if text[a] == " " and out:
                out[-1] = (*out[-1][:2], True, out[-1][3])
                a += 1
            if a < end:
                out += [(a + x, a + y, False, n) for x, y, n in self.chunk(text[a:end], exceptions)]
        return out

    def peeled(self, text: str, a: int, b: int, known: Mapping) -> tuple[int, int]:
        """What is left of [a, b) without a prefix, without a suffix or without both: the first of these that is an exception, else
        the last one."""
        head = self.prefix.search(text[a:b])
        inner = a + head.end() if head else a
        tail = self.suffix.search(text[inner:b])
        outer = b - len(tail[0]) if tail else b
        return next((w for w in ((inner, b), (a, outer)) if w != (a, b) and text[w[0] : w[1]] in known), (inner, outer))

    def chunk(self, text: str, exceptions: bool) -> list[tuple[int, int, str | None]]:
        """The core of a stretch, which is an exception or has nothing more to come off, between what was peeled off it."""
        known = self.rules.exceptions if exceptions else {}
        windows = [(0, len(text))]
        while (left := windows[-1])[0] < left[1] and text[left[0] : left[1]] not in known:
            windows.append(self.peeled(text, *left, known))
            if windows[-1] == left:
                break
        steps = list(zip(windows, windows[1:]))
        before = [(x[0], y[0], None) for x, y in steps if x[0] < y[0]]
        after = [(y[1], x[1], None) for x, y in steps if y[1] < x[1]]
        return [*before, *self.core(text, *windows[-1], known), *after[::-1]]

    def core(self, text: str, a: int, b: int, known: Mapping) -> list[tuple[int, int, str | None]]:
        if a >= b:
            return []
        rest = text[a:b]
        if rest in known:
            out, at = [], a
            for orth, given in known[rest]:
                out.append((at, at + len(orth), given))
                at += len(orth)
            return out
        if self.url.match(rest):
            return [(a, b, None)]
        out, at = [], a
        for m in self.infix.finditer(rest):
            if m.start() == 0:
                continue
            x, y = a + m.start(), a + m.end()
            if x > at:
                out.append((at, x, None))
            if y > x:
                out.append((x, y, None))
            at = y
        if at < b:
            out.append((at, b, None))
        return out

    def pieces(self, text: str) -> list[tuple[int, int, bool, str | None]]:
        """The second pass: exceptions that were split are found as token sequences, longest first. A rejected candidate still
        reserves its tokens."""
        raw = self.split(text)
        words = [text[a:b] for a, b, *_ in raw]
        found = []
        for i, w in enumerate(words):
            found += [(i, i + len(s)) for s in self.sequences.get(w, ()) if words[i : i + len(s)] == s]
        used = [False] * len(raw)
        chosen: dict[int, tuple[int, tuple]] = {}
        for i, j in sorted(found, key=lambda m: (m[0] - m[1], m[0])):
            rule = self.rules.exceptions.get(text[raw[i][0] : raw[j - 1][1]])
            if not used[i] and not used[j - 1] and rule:
                chosen[i] = (j, rule)
            used[i:j] = [True] * (j - i)
        out, i = [], 0
        while i < len(raw):
            if i not in chosen:
                out.append(raw[i])
                i += 1
                continue
            j, rule = chosen[i]
            at, end = raw[i][0], raw[j - 1][1]
            for k, (orth, given) in enumerate(rule):
                stop = at + len(orth)
                inner = text[stop : stop + 1] == " " and stop < end
                out.append((at, stop, inner or k == len(rule) - 1 and raw[j - 1][2], given))
                at = stop + inner
            i = j
        return out

    def __call__(self, text: str) -> list[dict]:
        return _records(text, self.pieces(text), self.rules.lexicon)


def tokenize(docs: DataFrame, rules: TokenizerRules) -> DataFrame:
    """Documents of the model with the rule tokenizer's tokens; a null text has none."""
    tokenizer = RuleTokenizer(rules)

    def run(d: dict) -> list[dict]:
        return [d | {"text": d["text"] or "", "tokens": tokenizer(d["text"] or "")}]

    return per_document(with_doc_columns(docs.select("doc_id", "text")), run, DOC_DDL)
