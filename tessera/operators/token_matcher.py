"""Token-sequence patterns: an exact breadth-first search for all patterns, and a window plan for those of fixed length.

Results carry `ord`, the order of discovery: by token, then state; states that were carried come before new starts, which
follow the order of the patterns. Rules with a greedy option come last, each filtered on its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import PatternError
from ..functions.lexical import FLAGS, Lexicon
from ..plans.patterns import ONE, STAR, Pattern
from ..plans.predicates import ANNOTATIONS, TokenView, all_of, check_document, columns_of
from .kernels import per_document, texts_of, views

GREEDY = (None, "first", "longest")
#: Bare words whose items a worker keeps.
KNOWN_WORDS = 1 << 17


@dataclass(frozen=True)
class Rule:
    patterns: tuple[Pattern, ...] = ()
    greedy: str | None = None


@dataclass(frozen=True)
class TokenMatcher:
    """An immutable registry: every change returns a new matcher, so a failed one changes nothing."""

    lexicon: Lexicon | None = None
    rules: Mapping[str, Rule] = field(default_factory=dict)
    #: All patterns in the order of their addition, which is the order of new starts.
    sequence: tuple[tuple[str, Pattern], ...] = ()

    def add(self, name: str, patterns: Sequence, greedy: str | None = None) -> TokenMatcher:
        """Appends patterns to a rule; the latest call decides the whole rule's greedy option."""
        if greedy not in GREEDY:
            raise PatternError(f"unknown greedy option {greedy}")
        new = tuple(p if isinstance(p, Pattern) else Pattern.of(p) for p in patterns)
        if self.lexicon is None and any(c.attribute in FLAGS for p in new for c in p.constraints()):
            raise PatternError("flags need a matcher with a lexicon")
        old = self.rules.get(name, Rule())
        return replace(self, rules={**self.rules, name: Rule(old.patterns + new, greedy)}, sequence=self.sequence + tuple((name, p) for p in new))

    def add_all(self, rules: Sequence[tuple[str, Sequence]]) -> TokenMatcher:
        """add() for many rules (name, patterns) without a greedy option, in one step."""
        new = [(n, tuple(p if isinstance(p, Pattern) else Pattern.of(p) for p in patterns)) for n, patterns in rules]
        if self.lexicon is None and any(c.attribute in FLAGS for _, ps in new for p in ps for c in p.constraints()):
            raise PatternError("flags need a matcher with a lexicon")
        held = dict(self.rules)
        for n, ps in new:
            held[n] = Rule(held.get(n, Rule()).patterns + ps)
        return replace(self, rules=held, sequence=self.sequence + tuple((n, p) for n, ps in new for p in ps))

    def remove(self, name: str) -> TokenMatcher:
        if name not in self.rules:
            raise PatternError(f"no rule {name}")
        return self.remove_all([name])

    def remove_all(self, names: Sequence[str]) -> TokenMatcher:
        gone = set(names)
        return replace(self, rules={k: v for k, v in self.rules.items() if k not in gone}, sequence=tuple(x for x in self.sequence if x[0] not in gone))

    def __len__(self) -> int:
        return len(self.rules)

    def __contains__(self, name: str) -> bool:
        return name in self.rules

    def get(self, name: str) -> Rule | None:
        return self.rules.get(name)

    def compiled(self) -> Search:
        return Search(self)

    def matches(self, doc: Mapping) -> list[tuple[str, int, int]]:
        """Matches of one document (a dict of the model's fields), in order."""
        return self.compiled()(doc)

    def find(self, docs: DataFrame, errors: bool = False) -> DataFrame:
        """doc_id, ord, rule, start, end; with errors, also error and message, one row for each failing document."""
        search = self.compiled()
        if not errors:
            return find_columns(docs.select("doc_id", F.struct("text", "tokens").alias("doc")), search, search.doc_columns)
        run = lambda d: [{"doc_id": d["doc_id"], "ord": i, "rule": r, "start": a, "end": b} for i, (r, a, b) in enumerate(search(d))]
        return per_document(docs.select("doc_id", "text", "tokens"), run, "doc_id bigint, ord int, rule string, start int, end int, error string, message string", errors)

    def find_words(self, docs: DataFrame) -> DataFrame:
        """doc_id, ord, rule, start, end over bare words (doc_id, words: array of strings), without annotations. Documents of a
        batch are searched as one text, with places between them where nothing holds."""
        search = self.compiled()
        if search.needs:
            return find_columns(docs.select("doc_id", "words"), search, search.word_columns)

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    yield _numbered(search, part.column(0), *search.batch_columns(part.column(1)))

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "words").mapInArrow(kernel, FOUND)


FOUND = "doc_id bigint, ord int, rule string, start int, end int"


def _numbered(search: Search, ids: pa.Array, doc: np.ndarray, rule: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Matches by document as rows, numbered within each."""
    sizes = np.bincount(doc, minlength=len(ids)) if len(ids) else np.zeros(0, np.int64)
    ord_ = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = lambda x: pa.array(x.astype(np.int32))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), whole(ord_), pa.array(search.names, pa.string()).take(whole(rule)), whole(start), whole(end)], ["doc_id", "ord", "rule", "start", "end"])


def find_columns(docs: DataFrame, search: Search, columns: Callable) -> DataFrame:
    """doc_id, ord, rule, start, end of what `columns` gives for the second column of each row: numbers of rules, starts, ends."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rule, start, end = zip(*(columns(x) for x in part.column(1).to_pylist()))
                doc = np.repeat(np.arange(len(rule)), [len(x) for x in rule])
                yield _numbered(search, part.column(0), doc, *map(np.concatenate, (rule, start, end)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), docs.columns[1]).mapInArrow(kernel, FOUND)


class Search:
    """The compiled patterns of a matcher."""

    def __init__(self, matcher: TokenMatcher) -> None:
        self.lexicon = matcher.lexicon
        self.greedy = {n: r.greedy for n, r in matcher.rules.items() if r.greedy}
        self.patterns = list(matcher.sequence)
        self.constraints = [c for _, p in self.patterns for c in p.constraints()]
        #: The constraints that ask something of a whole document before it is searched.
        self.needs = list({(c.attribute, c.kind): c for c in self.constraints if c.attribute in ANNOTATIONS}.values())
        #: Distinct items are tested once a token; a pattern's items are numbers of them.
        table: dict[tuple, int] = {}
        self.items = [[table.setdefault((i.constraints, i.repetition == "negated"), len(table)) for i in p.items] for _, p in self.patterns]
        self.tests: list[Callable[[Mapping], bool]] = [self._test(*k) for k in table]
        #: Patterns that start only at certain values, by attribute and value, and those that start anywhere.
        self.index: dict[str, dict[str, list[int]]] = {}
        self.anywhere: list[int] = []
        for k, (_, p) in enumerate(self.patterns):
            if not p.nodes:
                continue
            if first := p.first_values():
                for v in first[1]:
                    self.index.setdefault(first[0], {}).setdefault(v, []).append(k)
            else:
                self.anywhere.append(k)
        self.names = list(dict.fromkeys(n for n, _ in self.patterns))
        self.plan: Arrays | None = Arrays(self, list(table))

    @staticmethod
    def _test(constraints: tuple, negated: bool) -> Callable[[Mapping], bool]:
        inner = all_of(constraints)
        return (lambda t: not inner(t)) if negated else inner

    def starts(self, token: Mapping) -> list[int]:
        out = self.anywhere
        for attribute, by_value in self.index.items():
            if more := by_value.get(token[attribute]):
                out = out + more
        return sorted(out) if len(out) > len(self.anywhere) else out

    def __call__(self, doc: Mapping) -> list[tuple[str, int, int]]:
        return self.named(*self.doc_columns(doc))

    def doc_columns(self, doc: Mapping) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """columns() of a document."""
        if self.plan is not None and self.plan.lexical:
            return self.word_columns(texts_of(doc["text"] or "", doc["tokens"] or []))
        return self.columns(views(doc, self.lexicon))

    def words(self, words: Sequence[str]) -> list[tuple[str, int, int]]:
        """Matches over bare words, without annotations."""
        return self.named(*self.word_columns(words))

    def named(self, rule: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[str, int, int]]:
        return list(zip(map(self.names.__getitem__, rule.tolist()), start.tolist(), end.tolist()))

    def word_columns(self, words: Sequence[str] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """columns() of bare words: each distinct word is looked at once."""
        words = words or []
        if self.plan is None:
            seen = {w: TokenView(w, {}, self.lexicon) for w in set(words)}
            return self.columns([seen[w] for w in words])
        number = {w: k for k, w in enumerate(dict.fromkeys(words))}
        codes = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
        if self.needs:
            check_document(self.needs, [TokenView(w, {}, self.lexicon) for w in number])
        return self.greedily(self.plan.columns([self.plan.items_of_word(w) for w in number], codes))

    def batch_columns(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents (numbers in the batch) and columns() of them all, document by document."""
        sizes = np.asarray(pa.compute.list_value_length(words).fill_null(0), dtype=np.int64)
        coded = words.flatten().dictionary_encode()
        held = [self.plan.items_of_word(w) for w in coded.dictionary.to_pylist()]
        first = np.cumsum(sizes + 1) - (sizes + 1)
        codes = np.full(int((sizes + 1).sum()), len(held), dtype=np.int64)
        codes[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = np.asarray(coded.indices)
        rule, start, end = self.plan.columns([*held, []], codes)
        doc = np.searchsorted(first, start, side="right") - 1
        if self.greedy:
            cut = np.flatnonzero(np.diff(doc, prepend=-1))
            parts = [self.greedily((rule[a:b], start[a:b], end[a:b])) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(doc)])]
            rule, start, end = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
            doc = np.searchsorted(first, start, side="right") - 1
        return doc, rule, start - first[doc], end - first[doc]

    def columns(self, tokens: Sequence[TokenView]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of rules (in self.names), starts and ends of all matches, in order."""
        if self.plan is not None:
            if self.needs:
                check_document(self.needs, tokens)
            return self.greedily(self.plan.columns(list(map(self.plan.items_of, tokens)), np.arange(len(tokens))))
        rule = {n: k for k, n in enumerate(self.names)}
        found = self.stepped(tokens)
        return self.greedily(tuple(np.array(x, dtype=np.int64) for x in ([rule[m[0]] for m in found], [m[1] for m in found], [m[2] for m in found])))

    def greedily(self, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rules with a greedy option come last, each filtered on its own, in the order of their first matches."""
        if not self.greedy or not len(found[0]):
            return found
        rule, start, end = found
        numbers = [k for k, n in enumerate(self.names) if n in self.greedy]
        rest = np.flatnonzero(~np.isin(rule, numbers))
        parts = [rest]
        for k in dict.fromkeys(rule[np.isin(rule, numbers)].tolist()):
            own = np.flatnonzero(rule == k)
            parts.append(own[keep_greedy(start[own], end[own], self.greedy[self.names[k]])])
        order = np.concatenate(parts)
        return rule[order], start[order], end[order]

    def stepped(self, tokens: Sequence[TokenView]) -> list[tuple[str, int, int]]:
        """All matches by the breadth-first search over states."""
        check_document(self.constraints, tokens)
        found: list[tuple[str, int, int]] = []
        seen: set[tuple[str, int, int]] = set()

        def emit(k: int, start: int, end: int) -> None:
            m = (self.patterns[k][0], start, end)
            if end > start and m not in seen:
                seen.add(m)
                found.append(m)

        states: list[tuple[int, int, int]] = []  # pattern, node, start
        # Bare words share one view for each distinct word, which keeps what is known of it.
        known: dict[int, tuple[list[int], dict[int, bool]]] = {}
        for i, token in enumerate(tokens):
            starts, holds = known.get(id(token)) or known.setdefault(id(token), (self.starts(token), {}))
            if not states and not starts:
                continue
            kept: dict[tuple[int, int, int], None] = {}
            queue = states + [(k, 0, i) for k in starts]
            done: set[tuple[int, int, int]] = set()
            at = 0
            while at < len(queue):
                state = queue[at]
                at += 1
                if state in done:
                    continue
                done.add(state)
                k, node, start = state
                nodes = self.patterns[k][1].nodes
                item, kind = nodes[node]
                number = self.items[k][item]
                if number not in holds:
                    holds[number] = self.tests[number](token)
                ok, last = holds[number], node + 1 == len(nodes)
                if kind == ONE:
                    if ok and last:
                        emit(k, start, i + 1)
                    elif ok:
                        kept[k, node + 1, start] = None
                    continue
                # An item that need not occur: take the token, and go on without it at this token.
                if last:
                    emit(k, start, i)
                    if ok and kind == STAR:
                        kept[state] = None
                    elif ok:
                        emit(k, start, i + 1)
                elif ok and kind == STAR:
                    kept[state] = None
                    queue.insert(at, (k, node + 1, start))
                else:
                    if ok:
                        kept[k, node + 1, start] = None
                    queue.insert(at, (k, node + 1, start))
            states = list(kept)
        for k, node, start in states:
            if all(kind != ONE for _, kind in self.patterns[k][1].nodes[node:]):
                emit(k, start, len(tokens))
        return found


class Arrays:
    """The search over arrays instead of token by token. What a token fulfils is worked out once for each distinct token. Patterns
    whose nodes are of the same kinds go together: each is met where its rarest necessary item holds and from there extended over
    its other nodes, to the right and to the left.

    The breadth-first search would find a match at its last token, or, where the last node took nothing there, at the token
    after it, and at one token in the order of starts, then patterns. Sorting by these gives its order without its steps."""

    def __init__(self, search: Search, table: Sequence[tuple]) -> None:
        self.search = search
        shapes: dict[tuple[str, ...], list[int]] = {}
        for k, (_, p) in enumerate(search.patterns):
            if p.nodes:
                shapes.setdefault(tuple(kind for _, kind in p.nodes), []).append(k)
        #: Kinds of nodes, numbers of patterns, and the item of each node by pattern.
        self.shapes = [(kinds, np.array(own, dtype=np.int64), np.array([[search.items[k][i] for i, _ in search.patterns[k][1].nodes] for k in own], dtype=np.int64)) for kinds, own in shapes.items()]
        #: Items by an attribute and value that one of their constraints asks for; the others; and those that this alone decides.
        self.index: dict[str, dict[str, list[int]]] = {}
        self.others: list[int] = []
        self.decided: set[int] = set()
        for k, (constraints, negated) in enumerate(table):
            c = next((c for c in constraints if c.attribute in ("text", "lower") and c.kind in ("equals", "in", "is_subset", "intersects")), None)
            if c is None or negated:
                self.others.append(k)
                continue
            for v in {c.value} if c.kind == "equals" else set(c.value):
                self.index.setdefault(c.attribute, {}).setdefault(v, []).append(k)
            if len(constraints) == 1:
                self.decided.add(k)
        #: Whether texts alone say what holds: every item is decided by one value of a text or its lower case.
        self.plain = not self.others and len(self.decided) == len(table)
        self.known: dict[str, list[int]] = {}
        #: Whether the texts of tokens decide all items, whatever their annotations.
        self.lexical = all(c.attribute in ("text", "lower", "length", *FLAGS) for c in search.constraints)
        number = {name: k for k, name in enumerate(search.names)}
        self.rule_of = np.array([number[name] for name, _ in search.patterns], dtype=np.int64)

    def items_of(self, token: TokenView) -> list[int]:
        """The items that a token fulfils."""
        tests = self.search.tests
        held = [m for a, by in self.index.items() for m in by.get(token[a], ()) if m in self.decided or tests[m](token)]
        return held + [m for m in self.others if tests[m](token)]

    def items_of_word(self, word: str) -> list[int]:
        """The items that a bare word fulfils, kept for the next document."""
        held = self.known.get(word)
        if held is None:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            if self.plain:
                held = [m for a, by in self.index.items() for m in by.get(word if a == "text" else word.lower(), ())]
            else:
                held = self.items_of(TokenView(word, {}, self.search.lexicon))
            self.known[word] = held
        return held

    def columns(self, held: Sequence[list[int]], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rules, starts and ends of all matches, in order. held: the items that each distinct token fulfils; codes: which of these
        is at each place."""
        n = len(codes)
        none = (np.zeros(0, dtype=np.int64),) * 3
        if not n:
            return none
        at = Places(len(self.search.tests), held, codes)
        found = [x for kinds, patterns, items in self.shapes if (x := at.matches(kinds, patterns, items)) is not None]
        if not found:
            return none
        time, start, end, pattern = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((end, pattern, start, time))
        rule, start, end = self.rule_of[pattern[order]], start[order], end[order]
        _, once = np.unique((rule * (n + 1) + start) * (n + 2) + end, return_index=True)
        if len(once) < len(rule):
            once.sort()
            rule, start, end = rule[once], start[once], end[once]
        return rule, start, end


class Places:
    """The places of one document where items hold."""

    def __init__(self, items: int, held: Sequence[list[int]], codes: np.ndarray) -> None:
        item = [m for ms in held for m in ms]
        code = np.repeat(np.arange(len(held)), list(map(len, held)))
        self.n, self.codes, self.wide = len(codes), codes, len(held)
        key = np.unique(np.array(item, dtype=np.int64) * self.wide + code)
        self.held = key
        # Small tables of items and distinct tokens are looked up, others searched.
        self.table = None
        if items * self.wide <= 1 << 24:
            self.table = np.zeros(items * self.wide, dtype=bool)
            self.table[key] = True
        self.first = np.searchsorted(key, np.arange(items + 1) * self.wide)
        self.by_code = np.argsort(codes, kind="stable")
        self.count = np.bincount(codes, minlength=self.wide)
        self.begin = np.cumsum(self.count) - self.count
        often = np.concatenate([[0], np.cumsum(self.count[key % self.wide])])
        self.often = often[self.first[1:]] - often[self.first[:-1]]

    def holds(self, item: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the item holds at the place; nothing does outside of the text."""
        inside = (place >= 0) & (place < self.n)
        key = item * self.wide + self.codes[np.where(inside, place, 0)]
        if self.table is not None:
            return inside & self.table[key]
        at = np.minimum(np.searchsorted(self.held, key), max(0, len(self.held) - 1))
        return inside & (self.held[at] == key) if len(self.held) else np.zeros(len(key), dtype=bool)

    def where(self, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For items one by one: the number of the item, and each place where it holds."""
        which, at = _ranges(self.first[item], self.first[item + 1] - self.first[item])
        code = self.held[at] % self.wide
        again, place = _ranges(self.begin[code], self.count[code])
        return which[again], self.by_code[place]

    def over(self, kind: str, item: np.ndarray, p: np.ndarray, fixed: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Extends rows (pattern, fixed end, moving end) by a node: these, and whether the node took a token at last."""
        look = at if step > 0 else at - 1
        ok = self.holds(item[p], look)
        if kind == ONE:
            return p[ok], fixed[ok], at[ok] + step, np.ones(int(ok.sum()), dtype=bool)
        parts = [(p, fixed, at, np.zeros(len(p), dtype=bool))]
        while ok.any():
            p, fixed, at = p[ok], fixed[ok], at[ok] + step
            parts.append((p, fixed, at, np.ones(len(p), dtype=bool)))
            if kind != STAR:
                break
            ok = self.holds(item[p], at if step > 0 else at - 1)
        return tuple(np.concatenate(x) for x in zip(*parts))

    def distinct(self, p: np.ndarray, fixed: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = np.unique((p * (self.n + 1) + fixed) * (self.n + 1) + at)
        return key // (self.n + 1) ** 2, key // (self.n + 1) % (self.n + 1), key % (self.n + 1)

    def matches(self, kinds: tuple[str, ...], patterns: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, ...] | None:
        """Time, start, end and pattern of all matches of patterns of one shape."""
        needed = [k for k, kind in enumerate(kinds) if kind == ONE]
        if needed:
            anchor = min(needed, key=lambda k: int(self.often[items[:, k]].sum()))
            p, start = self.where(items[:, anchor])
            end = start + 1
        else:
            anchor, p, start = -1, np.repeat(np.arange(len(patterns)), self.n), np.tile(np.arange(self.n), len(patterns))
            end = start
        took = np.ones(len(p), dtype=bool)
        loose = any(kind != ONE for kind in kinds)
        for k in range(anchor + 1, len(kinds)):
            p, start, end, took = self.over(kinds[k], items[:, k], p, start, end, 1)
            if loose and k + 1 < len(kinds):
                p, start, end = self.distinct(p, start, end)
        time = end - took if kinds[-1] != STAR else end
        if anchor > 0:
            row = np.arange(len(p))
            p2, start2 = p, start
            for k in range(anchor - 1, -1, -1):
                p2, row, start2, _ = self.over(kinds[k], items[:, k], p2, row, start2, -1)
            p, start, end, time = p2, start2, end[row], time[row]
        full = end > start
        return (time[full], start[full], end[full], patterns[p[full]]) if full.any() else None


def _ranges(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of a start and a size: the number of its range, and each of its members."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def keep_greedy(start: np.ndarray, end: np.ndarray, how: str) -> np.ndarray:
    """Of overlapping matches the first (longer before shorter at one start) or the longest (earlier before later): the numbers
    of the matches that stay, in that order."""
    order = np.lexsort((-end, start) if how == "first" else (start, start - end))
    base = int(start.min()) if len(start) else 0
    taken = bytearray(int(end.max(initial=base)) - base)
    out = []
    for k, a, b in zip(order.tolist(), (start[order] - base).tolist(), (end[order] - base).tolist()):
        if taken.find(1, a, b) < 0:
            taken[a:b] = b"\x01" * (b - a)
            out.append(k)
    return np.array(out, dtype=np.int64)


def find_fixed(tokens: DataFrame, name: str, patterns: Sequence, lexicon: Lexicon = Lexicon(), order: str = "i", key: str = "doc_id") -> DataFrame:  # noqa: B008
    """doc_id, rule, start, end for patterns of fixed length, over the exploded token table: one window pass, in which each
    item's test is an expression and the tokens after the first are looked up with lead()."""
    w = Window.partitionBy(key).orderBy(order)
    out = None
    for p in (x if isinstance(x, Pattern) else Pattern.of(x) for x in patterns):
        if not p.fixed:
            raise PatternError("only patterns of fixed length have a window plan")
        tests = [columns_of(i.constraints, lexicon=lexicon) for i in p.items]
        tests = [~t if i.repetition == "negated" else t for t, i in zip(tests, p.items, strict=True)]
        marked = tokens.select(key, order, *[t.alias(f"__t{k}") for k, t in enumerate(tests)])
        hit = F.col("__t0")
        for k in range(1, len(tests)):
            hit = hit & F.coalesce(F.lead(f"__t{k}", k).over(w), F.lit(False))
        one = marked.withColumn("__hit", hit).where("__hit").select(key, F.lit(name).alias("rule"), F.col(order).alias("start"), (F.col(order) + len(tests)).alias("end"))
        out = one if out is None else out.unionByName(one)
    return out.distinct() if len(patterns) > 1 else out


def find_fixed_ahead(tokens: DataFrame, name: str, patterns: Sequence, lexicon: Lexicon = Lexicon(), order: str = "i", key: str = "doc_id") -> DataFrame:  # noqa: B008
    """find_fixed for patterns over token texts alone, on a table that already has each token's followers (next1, ...): a
    filter, with no exchange at all."""
    out = None
    for p in (x if isinstance(x, Pattern) else Pattern.of(x) for x in patterns):
        if not p.fixed or any(c.attribute not in ("text", "lower", "length", *FLAGS) for c in p.constraints()):
            raise PatternError("this plan is for patterns of fixed length over texts")
        hit = F.lit(True)
        for k, i in enumerate(p.items):
            text = f"next{k}" if k else "text"
            test = columns_of(i.constraints, text=text, lexicon=lexicon)
            hit = hit & F.coalesce((~test if i.repetition == "negated" else test) & F.col(text).isNotNull(), F.lit(False))
        one = tokens.where(hit).select(key, F.lit(name).alias("rule"), F.col(order).alias("start"), (F.col(order) + len(p.items)).alias("end"))
        out = one if out is None else out.unionByName(one)
    return out.distinct() if len(patterns) > 1 else out


__all__ = ["Rule", "Search", "TokenMatcher", "find_fixed", "find_fixed_ahead", "keep_greedy"]
