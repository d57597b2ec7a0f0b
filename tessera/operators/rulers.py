"""Rule-based annotation: the entity ruler and the span ruler, each token patterns and phrases under labels and ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..errors import PatternError
from ..functions.hashing import string_id
from ..functions.lexical import Lexicon
from .batches import Batch, from_rows, list_sizes, lists_of, stepped
from .entities import FILTERS, set_entities, set_group, tags_of, with_tags, write_tags
from .kernels import per_document
from .phrase_matcher import PhraseMatcher
from .token_matcher import Search, TokenMatcher


def _by_texts(search: Search, patterns: Sequence[RulePattern]) -> bool:
    """Whether token texts alone decide all matches, so that a batch of documents is one search."""
    return all(p.tokens is not None for p in patterns) and search.plan is not None and search.plan.lexical and not search.needs


class Placed:
    """Spans of a batch's documents by their places in all its tokens."""

    def __init__(self, batch: Batch, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        size = batch.sizes[doc]
        self.doc, self.start, self.end = doc, start, end
        self.a, self.b = (batch.first[doc] + np.clip(x, 0, size) for x in (start, end))

    def over(self, marked: np.ndarray) -> np.ndarray:
        """Whether any token of a span is marked."""
        before = np.concatenate([[0], np.cumsum(marked)])
        return before[np.maximum(self.a, self.b)] > before[self.a]

    def marks(self, n: int, which: np.ndarray) -> np.ndarray:
        """The tokens of some of the spans."""
        change = np.bincount(self.a[which], minlength=n + 1) - np.bincount(np.maximum(self.a, self.b)[which], minlength=n + 1)
        return np.cumsum(change)[:n] > 0

    def crowded(self) -> np.ndarray:
        """The documents where spans overlap."""
        order = np.lexsort((self.b, self.a))
        a, until = self.a[order], np.maximum.accumulate(self.b[order])
        return np.unique(self.doc[order][1:][a[1:] < until[:-1]])


def _entities_of(batch: Batch) -> tuple[Placed, pa.Array, pa.Array]:
    """The entities that documents have, their labels and ids."""
    lists = batch.columns.get("entities")
    if lists is None or not len(lists) or not len(flat := lists.flatten()):
        none = np.zeros(0, dtype=np.int64)
        return Placed(batch, none, none, none), pa.array([], pa.string()), pa.array([], pa.string())
    start, end = (np.asarray(flat.field(f), dtype=np.int64) for f in ("start", "end"))
    return Placed(batch, np.repeat(np.arange(len(lists)), list_sizes(lists)), start, end), flat.field("label"), flat.field("id")


def _as_entities(batch: Batch, old: tuple[Placed, pa.Array, pa.Array], kept: np.ndarray, new: Placed, added: np.ndarray, labels: Sequence[str], ids: Sequence[str | None], rule: np.ndarray) -> Batch:
    """The batch with some of the old entities and some of the new spans, every other token outside."""
    place, label, ident = old
    one = lambda x, y: np.concatenate([x[kept], y[added]])
    texts = lambda held, own: pa.concat_arrays([held.take(pa.array(kept)), pa.array(own, pa.string()).take(pa.array(rule[added]))])
    doc = one(place.doc, new.doc)
    spans = (doc, one(place.start, new.start), one(place.end, new.end), np.zeros(len(doc), dtype=np.int64), texts(label, labels), texts(ident, ids))
    return write_tags(batch, spans, ["outside"] * len(batch.sizes))


@dataclass(frozen=True)
class RulePattern:
    """label and id of a rule, and either token items or a phrase (its token keys)."""

    label: str
    tokens: tuple | None = None
    phrase: tuple[str, ...] | None = None
    id: str = ""

    @staticmethod
    def of(spec: Mapping) -> RulePattern:
        p = spec["pattern"]
        is_tokens = isinstance(p, Mapping) or len(p) > 0 and isinstance(p[0], Mapping)
        items = tuple(p["tokens"] if isinstance(p, Mapping) else p) if is_tokens else None
        return RulePattern(spec["label"], items, None if is_tokens else tuple(p), spec.get("id") or "")


@dataclass(frozen=True)
class EntityRuler:
    """Adds entities. Ties between matches of one length and start go to the rule that was added first."""

    overwrite_entities: bool = False
    phrase_attribute: str = "orth"
    id_separator: str = "||"
    lexicon: Lexicon | None = None
    symbols: Mapping[str, int] = field(default_factory=dict)
    patterns: tuple[RulePattern, ...] = ()

    def __post_init__(self) -> None:
        if not self.id_separator:
            raise PatternError("the separator is not empty")

    def name(self, p: RulePattern) -> str:
        return f"{p.label}{self.id_separator}{p.id}" if p.id else p.label

    def add(self, specs: Sequence) -> EntityRuler:
        """Token patterns are registered before phrases, so they rank first within one call."""
        new = [x if isinstance(x, RulePattern) else RulePattern.of(x) for x in specs]
        out = replace(self, patterns=self.patterns + tuple(p for p in new if p.tokens is not None) + tuple(p for p in new if p.phrase is not None))
        out.matchers()
        return out

    def remove(self, id: str) -> EntityRuler:
        if not any(p.id == id and id for p in self.patterns):
            raise PatternError(f"no rule has the id {id!r}")
        return replace(self, patterns=tuple(p for p in self.patterns if p.id != id))

    def clear(self) -> EntityRuler:
        return replace(self, patterns=())

    def __len__(self) -> int:
        return len(self.patterns)

    def labels(self) -> list[str]:
        return sorted({p.label for p in self.patterns})

    def ids(self) -> list[str]:
        return sorted({p.id for p in self.patterns if p.id})

    def matchers(self) -> tuple[TokenMatcher, PhraseMatcher]:
        t, p = TokenMatcher(self.lexicon), PhraseMatcher(self.phrase_attribute, self.lexicon, self.symbols)
        for r in self.patterns:
            if r.tokens is not None:
                t = t.add(self.name(r), [r.tokens])
            else:
                p = p.add(self.name(r), [r.phrase])
        return t, p

    def compiled(self):
        t, p = self.matchers()
        search, trie = t.compiled(), p.trie()
        rank: dict[str, int] = {}
        for r in self.patterns:
            rank.setdefault(self.name(r), len(rank))

        def run(doc: Mapping) -> list[tuple[str, int, int]]:
            found = {m for m in [*search(doc), *p.matches(doc, trie)] if m[2] > m[1]}
            return sorted(found, key=lambda m: (m[1] - m[2], m[1], rank[m[0]]))

        return run

    def spans(self, doc: Mapping, matches: Sequence[tuple[str, int, int]]) -> list[dict]:
        """The entities of the document after the ruler: accepted matches, and existing ones that overlap none of them."""
        n = len(doc["tokens"] or [])
        typed = [bool(t["entity_type"]) for t in doc["tokens"] or []]
        by_name = {self.name(p): p for p in reversed(self.patterns)}
        taken = [False] * n
        added = []
        for name, a, b in matches:
            if not self.overwrite_entities and any(typed[a:b]) or taken[a] or taken[b - 1]:
                continue
            taken[a:b] = [True] * (b - a)
            added.append({"start": a, "end": b, "label": by_name[name].label, "id": by_name[name].id or None})
        return [e for e in doc["entities"] or [] if not any(taken[e["start"] : e["end"]])] + added

    def annotated(self, doc: Mapping, matches: Sequence[tuple[str, int, int]]) -> dict:
        update = {"entities": self.spans(doc, matches), "default": "outside"}
        return with_tags(doc, set_entities(tags_of(doc), update))

    def step(self):
        """annotated() for a batch of documents."""
        run, search = self.compiled(), self.matchers()[0].compiled()
        if not _by_texts(search, self.patterns):
            return lambda batch: from_rows([self.annotated(d, run(d)) for d in batch.rows()])
        by_name = {self.name(p): p for p in reversed(self.patterns)}
        labels, ids = [by_name[n].label for n in search.names], [by_name[n].id or None for n in search.names]

        def one(batch: Batch) -> Batch:
            # The names of rules are in the order of their ranks.
            doc, rule, start, end = search.batch_columns(lists_of(batch.sizes, batch.words))
            new, old, n = Placed(batch, doc, start, end), _entities_of(batch), len(batch.words)
            open_ = np.ones(len(doc), dtype=bool)
            if not self.overwrite_entities:
                kind = batch.fields["entity_type"].fill_null("")
                open_ = ~new.over(np.asarray(pc.not_equal(kind, "")))
            crowded = np.isin(doc, Placed(batch, doc[open_], start[open_], end[open_]).crowded())
            if crowded.any():
                hard = np.flatnonzero(open_ & crowded)
                open_[hard] = False
                taken = bytearray(n)
                for k in hard[np.lexsort((rule[hard], start[hard], start[hard] - end[hard]))].tolist():
                    a, b = int(new.a[k]), int(new.b[k])
                    if not (taken[a] or taken[b - 1]):
                        taken[a:b] = b"\x01" * (b - a)
                        open_[k] = True
            kept = np.flatnonzero(~old[0].over(new.marks(n, open_)))
            return _as_entities(batch, old, kept, new, np.flatnonzero(open_), labels, ids, rule)

        return one

    def find(self, docs: DataFrame) -> DataFrame:
        """doc_id, ord, label, id, start, end of every match, longest first."""
        run, by_name = self.compiled(), {self.name(p): p for p in reversed(self.patterns)}
        rows = lambda d: [{"doc_id": d["doc_id"], "ord": i, "label": by_name[r].label, "id": by_name[r].id or None, "start": a, "end": b} for i, (r, a, b) in enumerate(run(d))]
        return per_document(docs.select("doc_id", "text", "tokens"), rows, "doc_id bigint, ord int, label string, id string, start int, end int")

    def annotate(self, docs: DataFrame) -> DataFrame:
        """The documents with the ruler's entities; every other token is outside, even where nothing matches."""
        return stepped(docs, self.step())


@dataclass(frozen=True)
class SpanRuler:
    """Adds spans to a group, and entities if asked to. Ties go by the unsigned keys of label and id."""

    spans_key: str | None = "ruler"
    spans_filter: str | None = None
    annotate_entities: bool = False
    entities_filter: str = "first_longest"
    phrase_attribute: str = "orth"
    overwrite: bool = True
    lexicon: Lexicon | None = None
    symbols: Mapping[str, int] = field(default_factory=dict)
    patterns: tuple[RulePattern, ...] = ()
    known_labels: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        for f in (self.spans_filter, self.entities_filter):
            if f is not None and f not in FILTERS:
                raise PatternError(f"unknown filter {f}")

    def add(self, specs: Sequence) -> SpanRuler:
        new = tuple(x if isinstance(x, RulePattern) else RulePattern.of(x) for x in specs)
        out = replace(self, patterns=self.patterns + new, known_labels=self.known_labels | {p.label for p in new})
        out.matchers()
        return out

    def remove(self, label: str) -> SpanRuler:
        if not any(p.label == label for p in self.patterns):
            raise PatternError(f"no rule has the label {label}")
        return replace(self, patterns=tuple(p for p in self.patterns if p.label != label))

    def remove_by_id(self, id: str) -> SpanRuler:
        if not any(p.id == id for p in self.patterns):
            raise PatternError(f"no rule has the id {id!r}")
        return replace(self, patterns=tuple(p for p in self.patterns if p.id != id))

    def clear(self) -> SpanRuler:
        return replace(self, patterns=())

    def __len__(self) -> int:
        return len(self.patterns)

    def __contains__(self, label: str) -> bool:
        return label in self.known_labels

    def labels(self) -> list[str]:
        """Labels stay known when their rules are removed."""
        return sorted(self.known_labels)

    def ids(self) -> list[str]:
        return sorted({p.id for p in self.patterns if p.id})

    def matchers(self) -> tuple[TokenMatcher, PhraseMatcher, dict[str, RulePattern]]:
        names: dict[tuple[str, str], str] = {}
        t, p = TokenMatcher(self.lexicon), PhraseMatcher(self.phrase_attribute, self.lexicon)
        by_name = {}
        for r in self.patterns:
            name = names.setdefault((r.label, r.id), str(len(names)))
            by_name[name] = r
            if r.tokens is not None:
                t = t.add(name, [r.tokens])
            else:
                p = p.add(name, [r.phrase])
        return t, p, by_name

    def compiled(self):
        t, p, by_name = self.matchers()
        search, trie = t.compiled(), p.trie()

        def run(doc: Mapping) -> list[dict]:
            found = {m for m in [*search(doc), *p.matches(doc, trie)] if m[2] > m[1]}
            spans = [{"start": a, "end": b, "label": by_name[r].label, "id": by_name[r].id or None} for r, a, b in found]
            return sorted(spans, key=lambda s: (s["start"], s["end"], string_id(s["label"], self.symbols), string_id(s["id"] or "", self.symbols)))

        return run

    def annotated(self, doc: Mapping, spans: Sequence[dict]) -> dict:
        out, n = dict(doc), len(doc["tokens"] or [])
        groups = doc["span_groups"] or []
        held = None if self.overwrite else next((g for g in groups if g["key"] == self.spans_key), None)
        if self.spans_key:
            added = FILTERS[self.spans_filter](held["spans"] if held else [], spans, n) if self.spans_filter else list(spans)
            if held:
                # With a filter the existing spans that it keeps are there twice.
                groups = [dict(g, spans=[*g["spans"], *added]) if g is held else g for g in groups]
            else:
                groups = set_group(groups, self.spans_key, added, n)
        if self.annotate_entities:
            old = [] if self.overwrite else doc["entities"] or []
            out = with_tags(out, set_entities(tags_of(doc), {"entities": FILTERS[self.entities_filter](old, spans, n), "default": "outside"}))
        return dict(out, span_groups=groups)

    def find(self, docs: DataFrame) -> DataFrame:
        run = self.compiled()
        rows = lambda d: [{"doc_id": d["doc_id"], "ord": i, **s} for i, s in enumerate(run(d))]
        return per_document(docs.select("doc_id", "text", "tokens"), rows, "doc_id bigint, ord int, start int, end int, label string, id string")

    def step(self):
        """annotated() for a batch of documents. Where no two spans of a document meet that a filter would rank, it takes or leaves
        them all at once."""
        run, (t, _, by_name) = self.compiled(), self.matchers()
        search, filter_ = t.compiled(), self.entities_filter
        alone = lambda batch: from_rows([self.annotated(d, run(d)) for d in batch.rows()])
        if self.spans_key or not self.annotate_entities or not _by_texts(search, self.patterns):
            return alone
        labels, ids = [by_name[n].label for n in search.names], [by_name[n].id or None for n in search.names]

        def one(batch: Batch) -> Batch:
            doc, rule, start, end = search.batch_columns(lists_of(batch.sizes, batch.words))
            new, n = Placed(batch, doc, start, end), len(batch.words)
            old = _entities_of(batch)
            place = old[0]
            whole = (0 <= place.start) & (place.start < place.end) & (place.end <= batch.sizes[place.doc])
            both = Placed(batch, *(np.concatenate(x) for x in ((place.doc, doc), (place.start, start), (place.end, end))))
            if self.overwrite or batch.columns["span_groups"].null_count or not whole.all() or len((both if filter_ == "first_longest" else new).crowded()):
                return alone(batch)
            kept, added = np.ones(len(place.doc), dtype=bool), np.ones(len(doc), dtype=bool)
            if filter_ == "prioritize_new":
                kept = ~place.over(new.marks(n, added))
            elif filter_ == "prioritize_existing":
                added = ~new.over(place.marks(n, kept))
            return _as_entities(batch, old, np.flatnonzero(kept), new, np.flatnonzero(added), labels, ids, rule)

        return one

    def annotate(self, docs: DataFrame) -> DataFrame:
        return stepped(docs, self.step())
